"""Text functions on columns: digits, scripts, canonical forms, distances, places of values in lines.

All are JVM expressions except ``fold_case``, the one step (compatibility composition and full case folding) that
Spark has no function for. Null in gives null out unless a docstring says otherwise.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
WESTERN_DIGITS = "01234567890123456789"
ALEF_FORMS, ALEF = "أإآٱ", "اااا"
FOLDED_FROM, FOLDED_TO = "ىةئؤکی", "يهيوكي"
KURDISH_LETTERS = "ڕڵێۆەڤپچگژ"
MARKS = "[ؐ-ًؚ-ٰٟۖ-ۭـ]"
_MARKS = [chr(c) for c in range(0x600, 0x700) if re.match(MARKS, chr(c))]
#: White space but for the blank and the line break.
SPACES = "\t\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@F.pandas_udf(T.StringType())
def fold_case(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def western_digits(c: Column) -> Column:
    return F.translate(c, ARABIC_DIGITS, WESTERN_DIGITS)


def is_kurdish(c: Column) -> Column:
    return c.rlike(f"[{KURDISH_LETTERS}]")


def script_of(c: Column) -> Column:
    """arabic, latin, mixed or none."""
    arabic, latin = c.rlike("[؀-ۿ]"), c.rlike("[A-Za-z]")
    return F.when(arabic & latin, "mixed").when(arabic, "arabic").when(latin, "latin").otherwise("none")


def normalized(c: Column) -> Column:
    """Canonical form for comparison only; null and '' give ''. Normalise each distinct value once, not each row."""
    text = F.regexp_replace(fold_case(F.coalesce(c, F.lit(""))), MARKS, "")
    text = F.translate(western_digits(text), ALEF_FORMS, ALEF)
    text = let(text, lambda t: F.when(is_kurdish(t), t).otherwise(F.translate(t, FOLDED_FROM, FOLDED_TO)))
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")
    return F.regexp_replace(text, r"(^| )عبد (?=\S)", "$1عبد")


def with_canonical_texts(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the canonical forms of an array of texts, as normalized gives them. A row's texts are folded together, as lines of
    one text: folding neither makes nor joins lines, and a line break within a text is white space like any other. One pass
    over the characters takes marks, digits, letters and white space. Null gives ''."""
    whole = F.array_join(F.transform(column, lambda x: F.translate(F.coalesce(x, F.lit("")), "\n", " ")), "\n")
    folded = df.withColumn("_whole", whole).withColumn("_folded", fold_case(F.col("_whole")))
    alike = lambda t, more="", to="": F.translate(t, ARABIC_DIGITS + ALEF_FORMS + more + SPACES + "".join(_MARKS), WESTERN_DIGITS + ALEF + to + " " * len(SPACES))
    each = F.array_join(F.transform(F.split("_folded", "\n"), lambda t: F.when(is_kurdish(t), alike(t)).otherwise(alike(t, FOLDED_FROM, FOLDED_TO))), "\n")
    text = F.when(is_kurdish(F.col("_folded")), each).otherwise(alike(F.col("_folded"), FOLDED_FROM, FOLDED_TO))
    when = lambda c, part, body: F.when(F.contains(c, F.lit(part)), body(c)).otherwise(c)
    folded = folded.withColumn("_text", text).withColumn("_text", when(F.col("_text"), "  ", lambda c: F.regexp_replace(c, " {2,}", " ")))
    folded = folded.withColumn("_text", F.trim(F.replace(F.replace("_text", F.lit("\n "), F.lit("\n")), F.lit(" \n"), F.lit("\n"))))
    lines = F.split(when(F.col("_text"), "عبد ", lambda c: F.regexp_replace(c, r"(?m)(^| )عبد (?=\S)", "$1عبد")), "\n")
    return folded.withColumn(out, F.when(F.size(column) > 0, lines).otherwise(F.array().cast("array<string>"))).drop("_whole", "_folded", "_text")


def with_normalized(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the canonical form of a text column: its different values are folded once each and joined back, so that a
    value costs Python the same however many rows hold it. Null gives ''."""
    known = df.select(F.col(column).alias("_raw")).where("_raw is not null").distinct().select("_raw", normalized(F.col("_raw")).alias("_canonical"))
    return df.join(known, F.col(column) == F.col("_raw"), "left").withColumn(out, F.coalesce("_canonical", F.lit(""))).drop("_raw", "_canonical")


def tokens(c: Column) -> Column:
    """The space-separated words of a canonical text."""
    return F.filter(F.split(c, " "), lambda x: x != "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of two canonical texts; equal ones (empty included) 1, one empty 0."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def character_error_rate(reference: Column, read: Column) -> Column:
    """Edits per reference character of two canonical texts; may exceed 1. Empty reference: 0 if read is empty, else 1."""
    return F.when(reference == "", F.when(read == "", 0.0).otherwise(1.0)).otherwise(F.levenshtein(reference, read) / F.char_length(reference))


def _characters(c: Column) -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))


def jaro(a: Column, b: Column) -> Column:
    """Share of characters that match within half the longer length, corrected for their order."""

    def of(x: Column, y: Column) -> Column:
        n, m = F.size(x), F.size(y)
        reach = F.greatest(F.floor(F.greatest(n, m) / 2).cast("int") - 1, F.lit(0))
        start = F.struct(F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("letters"))

        def step(state: Column, i: Column) -> Column:
            low, high = F.greatest(i - reach, F.lit(0)), F.least(i + reach, m - 1)
            around = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
            free = F.filter(around, lambda j: (F.get(y, j) == F.get(x, i)) & ~F.array_contains(state["places"], j))
            return let(
                F.get(free, F.lit(0)),
                lambda j: F.when(j.isNull(), state).otherwise(
                    F.struct(F.array_append(state["places"], j).alias("places"), F.array_append(state["letters"], F.get(x, i)).alias("letters"))
                ),
            )

        def score(state: Column) -> Column:
            k = F.size(state["places"])
            other = F.transform(F.array_sort(state["places"]), lambda j: F.get(y, j))
            moved = F.size(F.filter(F.zip_with(state["letters"], other, lambda p, q: p != q), lambda t: t)) / 2
            return F.when(k == 0, 0.0).otherwise((k / n + k / m + (k - moved) / k) / 3)

        return F.when((n == 0) | (m == 0), F.when(n == m, 1.0).otherwise(0.0)).otherwise(let(F.aggregate(F.sequence(F.lit(0), n - 1), start, step), score))

    return let(_characters(a), lambda x: let(_characters(b), lambda y: of(x, y)))


def common_prefix(a: Column, b: Column, most: int = 4) -> Column:
    """Length of the common prefix, at most `most`."""
    same = lambda k: (F.char_length(a) >= k) & (F.substring(a, 1, k) == F.substring(b, 1, k))
    equal = F.when(same(most), most)
    for k in range(most - 1, 0, -1):
        equal = equal.when(same(k), k)
    return equal.otherwise(0)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro with a boost of 0.1 for each common leading character, at every level."""
    return let(jaro(a, b), lambda s: s + common_prefix(a, b) * 0.1 * (1 - s))


def located(value: Column, text: Column) -> Column:
    """The slice of text that equals value but for runs of white space and digit scripts; null if there is none."""
    clean = western_digits(F.regexp_replace(F.regexp_replace(value, r"(?U)\s+", " "), "^ | $", ""))
    quoted = F.regexp_replace(clean, r"([\\\^$.|?*+()\[\]{}])", r"\\$1")
    pattern = F.replace(quoted, F.lit(" "), F.lit(r"\s+"))
    for d in range(10):
        pattern = F.replace(pattern, F.lit(str(d)), F.lit(f"[{d}{ARABIC_DIGITS[d]}{ARABIC_DIGITS[10 + d]}]"))
    return F.when(clean != "", F.regexp_substr(text, F.concat(F.lit("(?U)"), pattern)))


def _bare_object(reply: Column) -> Column:
    """What stands from the first { to the last } of a reply without its reasoning blocks and fences."""
    bare = F.regexp_replace(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    return F.regexp_substr(bare, F.lit(r"(?s)\{.*\}"))


def json_object(reply: Column, schema: str) -> Column:
    """The object in a reply (_bare_object) by a schema; null if bad."""
    return let(_bare_object(reply), lambda j: F.when(j.isNotNull(), F.from_json(j, schema)))


def parsed_reply(reply: Column) -> Column:
    """struct(object VARIANT, error): the object in a reply, whatever its shape, or why there is none: no_reply (null or
    blank), no_object (no braces), not_json. A bad reply is a row with an error, never a failed job."""

    def of(text: Column) -> Column:
        parsed = F.try_parse_json(text)
        blank = F.coalesce(F.trim(reply) == "", F.lit(True))
        error = F.when(blank, "no_reply").when(text.isNull(), "no_object").when(parsed.isNull(), "not_json")
        return F.struct(parsed.alias("object"), error.alias("error"))

    return let(_bare_object(reply), of)


def reply_value(parsed: Column, path: str, kind: str) -> Column:
    """A value of parsed_reply by its path ($.a.b[0]) as a type; null where it is missing or of another kind."""
    return F.try_variant_get(parsed["object"], path, kind)


def span_confidence(pieces: Column, reply: Column, fragment: Column) -> Column:
    """exp of the mean log probability of the pieces (token, logprob) that overlap fragment's first place in reply."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def of(first: Column) -> Column:
        def step(state: Column, piece: Column) -> Column:
            end = state["at"] + F.char_length(piece["token"])
            inside = (end > first) & (state["at"] < first + F.char_length(fragment))
            return F.struct(end.alias("at"), (state["sum"] + F.when(inside, piece["logprob"]).otherwise(0.0)).alias("sum"), (state["n"] + inside.cast("int")).alias("n"))

        return F.when(first >= 0, let(F.aggregate(pieces, start, step), lambda s: F.when(s["n"] > 0, F.exp(s["sum"] / s["n"]))))

    return let(F.instr(reply, fragment) - 1, of)


def without_values(c: Column) -> Column:
    """Text without digits and Arabic letters, fit to be shown outside."""
    return F.regexp_replace(c, f"[0-9{ARABIC_DIGITS}؀-ۿ]", "")
