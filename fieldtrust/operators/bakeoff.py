"""Comparison of readers on captures with known truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrust.functions.text import character_error_rate, normalized

#: Error rate by which the candidate reader may be worse than the best other and still read everything.
MARGIN = 0.05
GROUPS = ["names", "digits", "dates", "enums", "text"]


def best_line_values(lines: DataFrame, fields: DataFrame) -> DataFrame:
    """reader, capture, field, value, cer: of the first sample's lines the reading nearest to the truth (the text behind
    the label where the label is printed), the first of equals. This uses the truth: it is a best case."""
    first = lines.where("sample = 0").withColumns({"head": normalized(F.split_part("text", F.lit(":"), F.lit(1))), "has": F.contains("text", F.lit(":"))})
    paired = first.join(fields.select("capture", "field", "grp", "norm_label", "truth"), "capture")
    labelled = F.col("has") & (F.col("head") == F.col("norm_label"))
    value = F.trim(F.when(labelled, F.expr("substring(text, instr(text, ':') + 1)")).otherwise(F.col("text")))
    read = paired.withColumn("value", value).withColumns({"norm": normalized(F.col("value")), "norm_truth": normalized(F.col("truth"))})
    scored = read.withColumn("cer", character_error_rate(F.col("norm_truth"), F.col("norm")))
    best = scored.groupBy("reader", "capture", "field", "grp").agg(F.min(F.struct("cer", "pos", "value", "norm", "norm_truth")).alias("b"))
    return best.select("reader", "capture", "field", "grp", "b.value", "b.cer", F.col("b.norm").alias("norm"), F.col("b.norm_truth").alias("norm_truth"))


def reader_scores(best: DataFrame) -> DataFrame:
    """reader, name_cer (clipped to 1), digit_exact (spaces ignored), date_exact. Where best has the script of its capture's
    digits (digits: western or arabic_indic), digit_exact is of western ones and arabic_indic_digit_exact of the others."""
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    exact = (bare("norm") == bare("norm_truth")).cast("double")
    of = lambda g, v, more=F.lit(True): F.avg(F.when((F.col("grp") == g) & more, v))
    indic = F.coalesce(F.col("digits") == "arabic_indic", F.lit(False)) if "digits" in best.columns else None
    digits = [of("digits", exact).alias("digit_exact")] if indic is None else [of("digits", exact, ~indic).alias("digit_exact"), of("digits", exact, indic).alias("arabic_indic_digit_exact")]
    return best.groupBy("reader").agg(of("names", F.least("cer", F.lit(1.0))).alias("name_cer"), *digits, of("dates", (F.col("norm") == F.col("norm_truth")).cast("double")).alias("date_exact"))


def bucket_scores(best: DataFrame) -> DataFrame:
    """reader, bucket, name_cer of names by the photo's quality (best with bucket; null: good)."""
    names = best.where("grp = 'names'").withColumn("bucket", F.coalesce("bucket", F.lit("good")))
    return names.groupBy("reader", "bucket").agg(F.avg(F.least("cer", F.lit(1.0))).alias("name_cer"))


def image_counts(transcripts: DataFrame) -> DataFrame:
    """reader, n_images, failed_images of transcripts (reader, capture, sample, status): an image failed if its first sample did."""
    first = transcripts.groupBy("reader", "capture").agg(F.min_by("status", "sample").alias("status"))
    return first.groupBy("reader").agg(F.count("*").alias("n_images"), F.count(F.when(~F.col("status").eqNullSafe(F.lit("ok")), 1)).alias("failed_images"))


def pick_primary(scores: DataFrame, candidate: str) -> DataFrame:
    """grp, primary: the candidate for all groups if within MARGIN of the best other's name error, else for digits,
    dates and enums only. No rows where the candidate or all others lack a score."""
    own = scores.where(F.col("reader") == candidate).select(F.col("name_cer").alias("own"))
    other = scores.where((F.col("reader") != candidate) & F.col("name_cer").isNotNull()).agg(F.min(F.struct("name_cer", "reader")).alias("o")).where("o IS NOT NULL")
    both = own.crossJoin(other)  # one row each
    groups = F.explode(F.array(*map(F.lit, GROUPS))).alias("grp")
    keep = (F.col("own") - F.col("o.name_cer") <= MARGIN) | F.col("grp").isin("digits", "dates", "enums")
    return both.select("own", "o", groups).select("grp", F.when(keep, F.lit(candidate)).otherwise(F.col("o.reader")).alias("primary"))


def session_attempts(captures: DataFrame) -> DataFrame:
    """session_id, attempt, slots: captures grouped by the _c<k> ending of their names (else clean)."""
    ending = F.regexp_extract("capture", r"_(c\d+)$", 1)
    attempt = F.when(ending == "", "clean").otherwise(ending)
    return captures.groupBy("session_id", attempt.alias("attempt")).agg(F.array_sort(F.collect_list("slot")).alias("slots"))
