"""Comparison of multi-part personal names across scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.functions.text import jaro_winkler, let, normalized, script_of, tokens

# fixed values: letters and their Latin spelling
LETTERS = {
    "ا": "a", "ب": "b", "ت": "t", "ث": "th", "ج": "j", "ح": "h", "خ": "kh", "د": "d", "ذ": "dh", "ر": "r",
    "ز": "z", "س": "s", "ش": "sh", "ص": "s", "ض": "d", "ط": "t", "ظ": "dh", "ع": "", "غ": "gh", "ف": "f",
    "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w", "ي": "y", "ء": "",
}
# fixed values: spellings that sound alike, in the order in which they are replaced
ALIKE = [("q", "k"), ("dh", "d"), ("th", "t"), ("kh", "k"), ("gh", "g"), ("sh", "s"), ("j", "g"), ("z", "d")]
#: Token similarity that aligns two names of one script, and of two scripts.
ALIGNED, SPELLED = 0.92, 0.85


def latin_spelling(canonical: Column) -> Column:
    """Letter by letter; some letters become two or none, unknown ones stay."""
    table = F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair])
    return F.array_join(F.transform(F.split(canonical, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")


def consonants(latin: Column) -> Column:
    """Skeleton of a lower-case Latin spelling that vowels and spelling habits do not change."""
    for a, b in ALIKE:
        latin = F.replace(latin, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(latin, r"[aeiouyhw'\-\s]", ""), r"(.)\1+", "$1")


def aligned(short: Column, long_: Column, least: Column) -> Column:
    """struct(score, kept): the best order-preserving assignment of all short tokens to long ones; score null if none.

    One pass over the long tokens; the state holds for each number of assigned short tokens the best sum and the places
    taken. Of equal sums the one that takes the later place wins.
    """
    kind = "struct<score double, kept array<int>>"
    none = F.struct(F.lit(None).cast("double").alias("score"), F.array().cast("array<int>").alias("kept"))

    def of(table: Column) -> Column:
        first = F.concat(F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("kept"))), F.array_repeat(none, F.size(short))).cast(f"array<{kind}>")

        def column(state: Column, j: Column) -> Column:
            def cell(skip: Column, i: Column) -> Column:
                before, s = F.get(state, i - 1), F.get(F.get(table, i - 1), j)
                take = F.when(s >= least, before["score"] + s)
                taken = F.struct(take.alias("score"), F.array_append(before["kept"], j).alias("kept"))
                return F.when((i > 0) & take.isNotNull() & (skip["score"].isNull() | (take >= skip["score"])), taken).otherwise(skip).cast(kind)

            return F.transform(state, cell)

        return F.element_at(F.aggregate(F.sequence(F.lit(0), F.size(long_) - 1), first, column), -1)

    return let(F.transform(short, lambda a: F.transform(long_, lambda b: jaro_winkler(a, b))), of)


def name_match(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """struct(status, score, detail) of two names given with their canonical forms.

    skipped: a side is missing. mismatch: other given name, or no alignment. transliteration_match: an Arabic and a
    Latin spelling align. match: all tokens align. partial_match: the shorter name omits tokens, which detail lists.
    """
    sa, sb = script_of(a), script_of(b)
    crossed = ((sa == "arabic") & (sb == "latin")) | ((sa == "latin") & (sb == "arabic"))

    def parts(raw: Column, norm: Column, script: Column) -> Column:
        spelled = F.when(script == "arabic", F.transform(tokens(latin_spelling(norm)), consonants)).otherwise(F.transform(F.split(F.lower(raw), r"(?U)\s+"), consonants))
        return F.filter(F.when(crossed, spelled).otherwise(tokens(norm)), lambda t: t != "")

    def verdict(status: str | Column, score: Column | float, detail: str | Column) -> Column:
        text = [x if isinstance(x, Column) else F.lit(x) for x in (status, score, detail)]
        return F.struct(text[0].cast("string").alias("status"), text[1].cast("double").alias("score"), text[2].cast("string").alias("detail"))

    def compared(ta: Column, tb: Column) -> Column:
        least = F.when(crossed, SPELLED).otherwise(ALIGNED)
        given = F.when(crossed, jaro_winkler(F.get(ta, F.lit(0)), F.get(tb, F.lit(0))) >= SPELLED).otherwise(F.get(ta, F.lit(0)) == F.get(tb, F.lit(0)))
        short, long_ = F.when(F.size(ta) <= F.size(tb), ta).otherwise(tb), F.when(F.size(ta) <= F.size(tb), tb).otherwise(ta)

        def graded(best: Column) -> Column:
            score = best["score"] / F.size(long_)
            left = F.filter(long_, lambda x, k: ~F.array_contains(best["kept"], k))
            return (
                F.when(best["score"].isNull(), verdict("mismatch", 0.0, "name tokens do not align"))
                .when(crossed, verdict("transliteration_match", score, "matched only via transliteration"))
                .when(F.size(ta) == F.size(tb), verdict("match", score, ""))
                .otherwise(verdict("partial_match", score, F.concat(F.lit("shorter name omits: "), F.array_join(left, " "))))
            )

        return (
            F.when((F.size(ta) == 0) | (F.size(tb) == 0), verdict("skipped", 0.0, "name empty after normalisation"))
            .when(~given, verdict("mismatch", 0.0, "given name differs"))
            .otherwise(let(aligned(short, long_, least), graded))
        )

    missing = F.coalesce(a, F.lit("")).eqNullSafe("") | F.coalesce(b, F.lit("")).eqNullSafe("")
    return F.when(missing, verdict("skipped", 0.0, "name missing")).otherwise(let(parts(a, norm_a, sa), lambda ta: let(parts(b, norm_b, sb), lambda tb: compared(ta, tb))))


def with_name_match(pairs: DataFrame, left: str, right: str, out: str = "name_match") -> DataFrame:
    """pairs with the match of two name columns; each distinct pair is compared once and joined back."""
    distinct = pairs.select(F.col(left).alias("_l"), F.col(right).alias("_r")).distinct()
    normal = distinct.withColumns({"_nl": normalized(F.col("_l")), "_nr": normalized(F.col("_r"))})
    known = normal.select("_l", "_r", name_match(F.col("_l"), F.col("_r"), F.col("_nl"), F.col("_nr")).alias(out))
    return pairs.join(known, F.col(left).eqNullSafe(F.col("_l")) & F.col(right).eqNullSafe(F.col("_r"))).drop("_l", "_r")
