"""URL filters: explicit rules first, gradient-boosted trees on lexical features for the rest.

The rules also label the training rows: a URL that a rule decides is an example of its verdict. The trees see lexical
features only (lengths, depth, digit share, entropy, parameter counts, statistics of the host's suffix), never the
rules. Everything is DataFrame expressions and the boosted trees of Spark's own library.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.llm.common import hash_sample, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules become one expression each; a longer list belongs in a table.
MOST_RULES = 1000
#: A suffix table of at most so many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_SUFFIXES = 200_000


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    host, _, path = text.partition("/")
    return Rule(verdict, host.translate(str.maketrans(UPPER, LOWER)), "/" + path)


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty where url is null or has no ://."""
    parts = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    return df.withColumns({"host": F.translate(parts, UPPER, LOWER), "path": path})


def with_rule(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds rule and rule_verdict of the longest rule that fits; both null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError("too many rules for one expression")

    def fits(r: Rule) -> Column:
        return ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)

    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        text, verdict = F.when(fits(r), F.lit(r.text)).otherwise(text), F.when(fits(r), F.lit(r.verdict)).otherwise(verdict)
    return df.withColumns({"rule": text, "rule_verdict": verdict})


def _entropy(c: Column, alphabet: str) -> Column:
    """Bits a character of the distribution over the alphabet's characters and all others."""
    n = F.greatest(F.char_length(c), F.lit(1)).cast("double")
    counts = [F.char_length(c) - F.char_length(F.replace(c, F.lit(x), F.lit(""))) for x in alphabet]
    other = F.char_length(c)
    for x in counts:
        other = other - x
    total = F.lit(0.0)
    for x in [*counts, other]:
        total = total - F.when(x > 0, x / n * F.log2(F.greatest(x, F.lit(1)) / n)).otherwise(0.0)
    return total


FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_share", "path_digits", "longest_number", "hyphens", "capitals", "parameters", "query_length", "fragment", "secure", "extension", "encoded", "port", "host_entropy", "suffix_length", "suffix_seen", "first_length"]


def with_features(df: DataFrame, suffixes: DataFrame | None, url: str = "url") -> DataFrame:
    """Adds the lexical features; suffixes (suffix, seen) are logarithmic counts of host suffixes, a
    saved table: broadcast behind a count."""
    u = F.coalesce(F.col(url), F.lit(""))
    length = F.greatest(F.char_length(u), F.lit(1)).cast("double")
    digits = F.char_length(u) - F.char_length(F.regexp_replace(u, "[0-9]", ""))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    out = df.withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1))
    if suffixes is None:
        out = out.withColumn("seen", F.lit(0.0))
    else:
        out = out.join(F.broadcast(suffixes) if suffixes.count() <= BROADCAST_SUFFIXES else suffixes, "suffix", "left")
    values = {
        "url_length": F.char_length(u),
        "host_length": F.char_length("host"),
        "path_length": F.char_length("path"),
        "depth": F.char_length("path") - F.char_length(F.replace("path", F.lit("/"), F.lit(""))),
        "labels": F.char_length("host") - F.char_length(F.replace("host", F.lit("."), F.lit(""))),
        "digit_share": digits / length,
        "path_digits": F.char_length("path") - F.char_length(F.regexp_replace("path", "[0-9]", "")),
        "longest_number": F.char_length(F.regexp_extract("path", r"([0-9]+)", 1)),
        "hyphens": F.char_length("host") - F.char_length(F.replace("host", F.lit("-"), F.lit(""))),
        "capitals": F.char_length(u) - F.char_length(F.regexp_replace(u, "[A-Z]", "")),
        "parameters": F.when(query == "", 0).otherwise(1 + F.char_length(query) - F.char_length(F.replace(query, F.lit("&"), F.lit("")))),
        "query_length": F.char_length(query),
        "fragment": F.contains(u, F.lit("#")).cast("int"),
        "secure": F.startswith(u, F.lit("https")).cast("int"),
        "extension": F.rlike("path", F.lit(r"\.[A-Za-z]{2,5}$")).cast("int"),
        "encoded": F.char_length(u) - F.char_length(F.replace(u, F.lit("%"), F.lit(""))),
        "port": F.rlike("host", F.lit(r":[0-9]+$")).cast("int"),
        "host_entropy": _entropy(F.col("host"), LOWER + "0123456789-."),
        "suffix_length": F.char_length("suffix"),
        "suffix_seen": F.coalesce("seen", F.lit(0.0)),
        "first_length": F.char_length(F.regexp_extract("path", r"^/?([^/]*)", 1)),
    }
    return out.withColumns({k: v.cast("double") for k, v in values.items()}).drop("suffix", "seen")


def fit(labelled: DataFrame, trees: int = 12, depth: int = 4) -> GBTClassificationModel | float:
    """Trees fitted to a bounded sample of rows (label 1 = block, the features), or the one label's share where fewer
    than two labels occur."""
    sample = labelled.select("label", *FEATURES)
    rows = sorted(sample.collect())  # bounded; one partition in one order keeps the sums the same
    seen = {r.label for r in rows}
    if len(seen) < 2:
        return float(seen.pop()) if seen else 0.0
    local = labelled.sparkSession.createDataFrame(rows, sample.schema).coalesce(1)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(local).select("label", "features")
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=11, maxBins=64).fit(vectors.cache())


def judge(pages: DataFrame, rules: list[Rule], most_rows: int = 4000, threshold: float = 0.5) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block) and block_score (the trees' probability of block).

    A rule's verdict goes before the trees'; of rules of equal length that fit, the last by text decides. Null urls and those without :// have empty parts and are judged by the
    trees, which allow a url at exactly `threshold`. Without labelled rows everything the rules leave open is allowed. Rows repeat as given; columns of pages
    with the added names are replaced. The trees are fitted to at most most_rows labelled rows; suffix statistics
    cover all rows and all suffixes.
    """
    # the given columns travel as one, so that none of them clashes with a name used here
    held = pages.drop("host", "path", "rule", "verdict", "block_score").select(F.struct("*").alias("given"), "url")
    parts = with_rule(with_parts(held), rules)
    counts = parts.groupBy(F.regexp_extract("host", r"([^.]*)$", 1).alias("suffix")).agg(F.log1p(F.count("*").cast("double")).alias("seen"))
    total = F.log1p(F.lit(float(parts.count())))
    suffixes = saved(counts.withColumn("seen", F.round(F.col("seen") - total, 3)), "suffixes")
    scored = with_features(parts, suffixes)
    # one row of a URL is enough to learn from
    urls = hash_sample(parts.where("rule_verdict is not null and url is not null").select("url", "host", "path", "rule_verdict"), "url", most_rows)
    model = fit(with_features(urls, suffixes).withColumn("label", (F.col("rule_verdict") == "block").cast("double")))
    if isinstance(model, float):
        out = scored.withColumn("block_score", F.lit(model))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="lexical_features").transform(scored)
        judged = model.setFeaturesCol("lexical_features").setProbabilityCol("lexical_probability").setRawPredictionCol("").setPredictionCol("").transform(vectors)
        out = judged.withColumn("block_score", vector_to_array("lexical_probability")[1]).drop("lexical_features", "lexical_probability")
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_score") > threshold, "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).select("given.*", "host", "path", "rule", "verdict", "block_score")
