"""Benchmark decontamination by winnowing.

Both sides are cut into words. Of the k-gram hashes in every sliding window the smallest is kept, with its place. With
k + w - 1 equal to the span that must be found, two texts that share such a span share a kept hash inside it. The kept
hashes of all documents are joined with those of the benchmark; each match is extended to the spans around it, which
are compared word for word. Items shorter than the span are matched whole, from their first word.

DataFrame functions only. While the benchmark's hashes are few enough to be broadcast, the document's words go through the
join as a reference next to each kept hash and are written only for matches, so texts are neither shuffled nor read twice
for it. Beyond that the kept hashes go through a shuffle alone, and the places that match are brought back to the texts of
the documents that have any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrust.llm.common import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is no word character once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A kept hash holds its place in the low bits: texts of up to 2**28 words.
PLACE_BITS = 28
#: Words of a short item that a document must have in a row before the whole item is compared.
LEAD = 3
#: Benchmark rows (fingerprints, spans) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def words(text: str = "text") -> Column:
    """The words of a text as an array; empty for null."""
    body = F.coalesce(F.col(text), F.lit(""))
    # lower() changes only A-Z where a text is plain ASCII, and is much faster there
    small = F.when(F.octet_length(body) == F.char_length(body), F.lower(body)).otherwise(F.translate(body, UPPER, LOWER))
    return F.filter(F.split(small, BETWEEN), lambda w: w != "")


def kept_hashes(found: Column, k: int, w: int) -> Column:
    """The smallest k-gram hash of each window of w k-grams, once for each place: hash and place in one long."""
    n = F.size(found)
    grams = F.transform(
        F.sequence(F.lit(0), n - k),
        lambda i: F.shiftleft(F.xxhash64(*[F.get(found, i + j) for j in range(k)]), PLACE_BITS).bitwiseOR(i.cast("long")),
    )
    # the outer transform binds the hashes once; named inside the inner one they would be made anew for each window
    least = F.transform(F.array(grams), lambda g: F.transform(F.sequence(F.lit(0), n - k - w + 1), lambda i: F.array_min(F.slice(g, i + 1, w))))
    return F.when(n >= k + w - 1, F.array_distinct(F.get(least, F.lit(0))))


def _checked(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def hits(docs: DataFrame, benchmark: DataFrame, span: int, k: int) -> DataFrame:
    """doc_id, first, length, item_id: the places in documents where a benchmark window occurs."""
    w = span - k + 1
    items = saved(benchmark.where("item_id is not null").select("item_id", words().alias("words")).where("size(words) > 0"), "items")
    long_items, short_items = items.where(F.size("words") >= span), items.where(F.size("words") < span)
    windows = long_items.select(
        "item_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - span), lambda i: F.array_join(F.slice("words", i + 1, span), " "))).alias("window")
    ).distinct()
    prints = saved(long_items.select(F.explode(kept_hashes(F.col("words"), k, w)).alias("h")).select(F.shiftrightunsigned("h", PLACE_BITS).alias("print")).distinct(), "prints")
    source = docs.where("doc_id is not null").select("doc_id", words().alias("words"))
    # a match at place p lies in spans that begin between p - w + 1 and p
    if prints.count() <= BROADCAST_ROWS:
        kept = source.select("doc_id", "words", F.explode(kept_hashes(F.col("words"), k, w)).alias("h"))
        matched = kept.withColumn("print", F.shiftrightunsigned("h", PLACE_BITS)).join(F.broadcast(prints), "print")
    else:
        kept = source.select("doc_id", F.explode(kept_hashes(F.col("words"), k, w)).alias("h"))
        own = kept.withColumn("print", F.shiftrightunsigned("h", PLACE_BITS)).join(prints, "print").groupBy("doc_id").agg(F.collect_set("h").alias("hs"))
        own = saved(own, "matches")
        matched = source.join(_checked(own, BROADCAST_ROWS // 100), "doc_id").select("doc_id", "words", F.explode("hs").alias("h"))
    place = F.col("h").bitwiseAND((1 << PLACE_BITS) - 1).cast("int")
    from_ = F.greatest(place - (w - 1), F.lit(0))
    around = saved(matched.select("doc_id", from_.alias("from"), F.slice("words", from_ + 1, F.least(place, F.size("words") - span) - from_ + span).alias("near")), "around")
    spans = around.select("doc_id", "from", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("near") - span), lambda i: F.array_join(F.slice("near", i + 1, span), " "))).alias("at", "window"))
    found = spans.select("doc_id", (F.col("from") + F.col("at")).alias("first"), "window").distinct()
    windows = saved(windows, "windows")
    out = found.join(_checked(windows), "window").select("doc_id", "first", F.lit(span).alias("length"), "item_id")
    first_words = F.least(F.size("words"), F.lit(LEAD))
    short = saved(short_items.select("item_id", F.size("words").alias("length"), first_words.alias("lead"), F.array_join(F.slice("words", F.lit(1), first_words), " ").alias("begin"), F.array_join("words", " ").alias("window")), "short")
    for n in sorted(r.lead for r in short.select("lead").distinct().collect()):  # at most LEAD of them
        own = short.where(F.col("lead") == n)
        if own.count() <= BROADCAST_ROWS:
            begins = F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.array_join(F.slice("words", i + 1, n), " "))
            whole = source.where(F.size("words") >= n).select("doc_id", "words", F.posexplode(begins).alias("first", "begin")).join(F.broadcast(own), "begin")
        else:
            begins = F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.array_join(F.slice("words", i + 1, n), " "))
            marks = source.where(F.size("words") >= n).select("doc_id", F.posexplode(begins).alias("first", "begin"))
            found = saved(marks.join(own, "begin").select("doc_id", "first", "length", "item_id", "window"), "begins")
            whole = source.join(found, "doc_id")
        whole = whole.where(F.array_join(F.slice("words", F.col("first") + 1, F.col("length")), " ") == F.col("window"))
        out = out.union(whole.select("doc_id", "first", "length", "item_id"))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs.

    n_hit counts the document's words inside any occurrence of a window (span consecutive words of an item; the whole
    item if it has fewer). Null and empty texts have no words; items without words or with a null id match nothing. A
    doc_id names one text; its equal rows all come out. A null doc_id has its words counted and no hits. Extra columns
    are ignored; empty tables on either side are fine.
    """
    found = saved(hits(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), span, k), "hits")
    places = found.select("doc_id", "first", (F.col("first") + F.col("length")).alias("end")).groupBy("doc_id", "first").agg(F.max("end").alias("end"))
    before = Window.partitionBy("doc_id").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    fresh = places.withColumn("past", F.coalesce(F.max("end").over(before), F.lit(0)))
    covered = fresh.groupBy("doc_id").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("first", "past"))).cast("long").alias("n_hit"))
    items = found.select("doc_id", "item_id").distinct().groupBy("doc_id").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ","), 256).alias("items_sha256"))
    marks = saved(covered.join(items, "doc_id"), "marks")
    counted = docs.select("doc_id", F.size(words()).cast("long").alias("n_words"))
    return counted.join(_checked(marks), "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
