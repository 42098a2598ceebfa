"""Accuracy, calibration and routing measures over observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.operators.ranking import mass_bin, with_rank
from fieldtrust.operators.scan import running_sums


def share(test: Column, among: Column | None = None) -> Column:
    """Mean of a test over the rows among; null where there are none."""
    value = F.coalesce(test, F.lit(False)).cast("double")
    return F.avg(value if among is None else F.when(among, value))


def field_observations(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each expected field: truth (null where unreadable), its prediction if any, exact and correct.

    truth: keys, truth, norm_truth, ...; predicted: keys, value, norm_value, ...
    """
    joined = truth.join(predicted, keys, "left")
    both_null = F.col("truth").isNull() & F.col("value").isNull()
    return joined.withColumns({"exact": F.col("value").eqNullSafe(F.col("truth")), "correct": both_null | F.coalesce(F.col("norm_truth") == F.col("norm_value"), F.lit(False))})


def summary_columns() -> list[Column]:
    """The measures of a group of observations (kind: the field's group, truth, value, exact, correct, cer, status). Matches
    and coverage are over readable fields, error rates over those of them with a value: of names and texts, of digits, and
    of all. A measure without any row is null."""
    readable, given = F.col("truth").isNotNull(), F.col("value").isNotNull()
    rate = lambda *kinds: F.avg(F.when(readable & given & (F.col("kind").isin(*kinds) if kinds else F.lit(True)), F.col("cer")))
    return [
        F.count("*").alias("n"),
        share(F.col("exact"), readable).alias("exact"),
        share(F.col("correct"), readable).alias("normalised"),
        share(given, readable).alias("coverage"),
        rate().alias("cer"),
        rate("names", "text").alias("cer_text"),
        rate("digits").alias("cer_digits"),
        share(~readable, ~given).alias("null_precision"),
        share(~given, ~readable).alias("null_recall"),
        share(given, ~readable).alias("hallucination"),
        F.count(F.when(~readable, 1)).alias("n_unreadable"),
        share(F.col("correct"), given & (F.col("status") == "ok")).alias("ok_accuracy"),
    ]


def field_summary(observations: DataFrame, *by: str) -> DataFrame:
    return observations.groupBy(*by).agg(*summary_columns())


def sliced_summary(observations: DataFrame, slices: list[str]) -> DataFrame:
    """The measures overall and by each slice column alone, in one pass by grouping sets."""
    sets = [[F.col(s)] for s in slices]
    grouped = observations.groupingSets([[], *sets], *map(F.col, slices)).agg(F.grouping_id(*slices).alias("_set"), *summary_columns())
    name, value = F.lit("overall"), F.lit("all")
    full = (1 << len(slices)) - 1
    for i, s in enumerate(slices):
        own = full & ~(1 << (len(slices) - 1 - i))
        name = F.when(F.col("_set") == own, s).otherwise(name)
        value = F.when(F.col("_set") == own, F.col(s).cast("string")).otherwise(value)
    return grouped.select(name.alias("slice"), value.alias("slice_value"), *[c for c in grouped.columns if c not in (*slices, "_set")])


def reliability_bins(scores: DataFrame, bins: int = 15) -> DataFrame:
    """bin, mean_p, mean_y, n of equal-mass bins of scores (id, p, y); ties go by id."""
    ranked = with_rank(scores, "p", "id")
    total = scores.agg(F.count("*").alias("total"))
    return ranked.crossJoin(F.broadcast(total)).withColumn("bin", mass_bin(F.col("rank"), F.col("total"), bins).cast("int")).groupBy("bin").agg(F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"), F.count("*").alias("n"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """ece of reliability_bins."""
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))


def brier(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2))).alias("brier"))


def selective_risk(scores: DataFrame, steps: int = 20) -> DataFrame:
    """threshold, coverage, error over the scores at or above it, for 0, 1/steps, ..., 1; empty ones are left out.

    Rows fall into steps + 1 buckets first; the thresholds then see only the histogram.
    """
    bucket = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0), lambda s, i: s + (F.col("p") >= i / F.lit(float(steps))).cast("int"))
    histogram = scores.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum("y").alias("right"))
    reached = histogram.select(F.explode(F.sequence(F.lit(0), F.col("bucket"))).alias("step"), "n", "right").groupBy("step").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    total = histogram.agg(F.sum("n").alias("total"))
    return reached.crossJoin(F.broadcast(total)).select((F.col("step") / float(steps)).alias("threshold"), (F.col("n") / F.col("total")).alias("coverage"), (1 - F.col("right") / F.col("n")).alias("error"))


def choose_thresholds(scores: DataFrame, target: float = 0.99) -> DataFrame:
    """grp, tau, coverage for each group of scores (grp, p, y): the smallest score rounded to 4 places at and above which the
    precision reaches the target; 1.01 and 0 if there is none.

    Scores are counted by value; one running sum over the ranges of (group, falling value) serves all groups. A null score
    is in the total but reaches no threshold."""
    values = scores.where("p is not null").groupBy("grp", "p").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("right"))
    # a score counts for a candidate if it reaches it unrounded: its own candidate or the next smaller one
    none = F.lit(0).cast("long")
    marks = F.array(F.struct(F.col("p").alias("at"), F.lit(0).alias("kind"), "n", "right"), F.struct(F.round("p", 4).alias("at"), F.lit(1).alias("kind"), none.alias("n"), none.alias("right")))
    at_once = values.select("grp", F.explode(marks).alias("m")).select("grp", "m.*").groupBy("grp", "at").agg(F.max("kind").alias("kind"), F.sum("n").alias("n"), F.sum("right").alias("right"))
    summed = running_sums(at_once, ["grp", F.desc("at")], {"n_from": "n", "right_from": "right"})
    base = summed.groupBy(F.col("grp").alias("_grp")).agg(F.min(F.col("n_from") - F.col("n")).alias("n_base"), F.min(F.col("right_from") - F.col("right")).alias("right_base"))  # what the groups before add up to
    total = scores.groupBy("grp").agg(F.count("*").alias("total"))
    own = summed.where("kind = 1").join(base, F.col("grp").eqNullSafe(F.col("_grp"))).select("grp", "at", (F.col("n_from") - F.col("n_base")).alias("n"), (F.col("right_from") - F.col("right_base")).alias("right"))
    fit = own.where("n > 0").where(F.col("right") / F.col("n") >= target).groupBy(F.col("grp").alias("_grp")).agg(F.min(F.struct("at", "n")).alias("best"))
    joined = total.join(fit, F.col("grp").eqNullSafe(F.col("_grp")), "left")
    return joined.select("grp", F.coalesce("best.at", F.lit(1.01)).alias("tau"), F.coalesce(F.col("best.n") / F.col("total"), F.lit(0.0)).alias("coverage"))


def choose_threshold(scores: DataFrame, target: float = 0.99) -> DataFrame:
    """tau, coverage over all scores (p, y) together; see choose_thresholds."""
    return choose_thresholds(scores.select(F.lit(0).alias("grp"), "p", "y"), target).drop("grp")


def routing_metrics(sessions: DataFrame) -> DataFrame:
    """Review rate, precision, recall, F1, auto-pass rate and error of sessions (routed, needed: BOOLEAN)."""
    n = lambda c: F.sum(c.cast("long"))
    hit, routed, needed = n(F.col("routed") & F.col("needed")), n(F.col("routed")), n(F.col("needed"))
    precision, recall = F.try_divide(hit, routed), F.try_divide(hit, needed)
    return sessions.agg(
        F.count("*").alias("n"),
        share(F.col("routed")).alias("review_rate"),
        precision.alias("precision"),
        recall.alias("recall"),
        F.try_divide(2 * hit, routed + needed).alias("f1"),
        share(~F.col("routed")).alias("auto_pass_rate"),
        share(F.col("needed"), ~F.col("routed")).alias("auto_pass_error"),
    )


def variant_recall(sessions: DataFrame) -> DataFrame:
    """variant, n, routed: the share of sessions of each variant that were routed."""
    return sessions.select(F.explode("variants").alias("variant"), "routed").groupBy("variant").agg(F.count("*").alias("n"), share(F.col("routed")).alias("routed"))


def session_observations(observations: DataFrame) -> DataFrame:
    """session_id, needed: whether any required field is wrong or unreadable."""
    return observations.groupBy("session_id").agg(F.bool_or(F.col("required") & (~F.col("correct") | F.col("truth").isNull())).alias("needed"))


def session_scores(observations: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """For each session: field_score (share of right fields) and wrong (sorted names), hallucination_score (share of
    unreadable fields without a value; 1 if there are none) and invented, and, with routes (session_id, routed,
    human_expected), routing_score: whether it was routed if and only if a person was needed, which an unreadable field,
    also an optional one, or a wrong required one calls for. A session without a route (its run failed) scores 0 there."""
    unreadable = F.col("truth").isNull()
    names = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("field"))))
    bad = ~F.coalesce(F.col("correct"), F.lit(False))
    found = observations.groupBy("session_id").agg(
        share(F.col("correct")).alias("field_score"),
        names(bad).alias("wrong"),
        F.coalesce(share(F.col("value").isNull(), unreadable), F.lit(1.0)).alias("hallucination_score"),
        names(unreadable & F.col("value").isNotNull()).alias("invented"),
        names(bad & F.col("required")).alias("required_wrong"),
        F.bool_or(unreadable).alias("_unreadable"),
    )
    if routes is None:
        return found.drop("required_wrong", "_unreadable")
    joined = found.join(routes.select("session_id", "routed", "human_expected"), "session_id", "left")
    needed = F.coalesce("human_expected", F.lit(False)) | (F.size("required_wrong") > 0) | F.col("_unreadable")
    return joined.withColumn("human_needed", needed).withColumn("routing_score", F.coalesce((F.col("routed") == F.col("human_needed")).cast("double"), F.lit(0.0))).drop("_unreadable", "human_expected")


def split_of(rank: Column, n: Column) -> Column:
    """60 / 20 / 20 of n ranked identities, the remainder to the last."""
    tune, calibration = F.round(n * 0.6), F.round(n * 0.2)
    return F.when(rank <= tune, "tune").when(rank <= tune + calibration, "calibration").otherwise("test")


def assign_splits(rows: DataFrame, identity: str, seed: str) -> DataFrame:
    """rows with split; all rows of an identity go together, by the order of a seeded hash."""
    ids = rows.select(identity).distinct().withColumn("order", F.md5(F.concat(F.lit(seed), F.col(identity).cast("string"))))
    ranked = with_rank(ids, "order", identity)
    total = ids.agg(F.count("*").alias("n"))
    return rows.join(ranked.crossJoin(F.broadcast(total)).select(identity, split_of(F.col("rank"), F.col("n")).alias("split")), identity)


def sample_per_type(rows: DataFrame, kind: str, id_column: str, n: int, seed: str) -> DataFrame:
    """Up to n rows of each kind in the order of a seeded hash; a top-n in each task goes before the shuffle."""
    from pyspark.sql import Window

    ordered = rows.withColumn("_order", F.md5(F.concat(F.lit(seed), F.col(id_column).cast("string"))))
    best = Window.partitionBy(kind).orderBy("_order", id_column)
    return ordered.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= n).drop("_order", "_k")


def table_hash(rows: DataFrame) -> DataFrame:
    """hash: of the number of rows and the sums of four parts (60 bits each) of the rows' own hashes, whatever their order
    and however many there are; no rows are gathered."""
    own = rows.select(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(rows.columns)]), 256).alias("h"))
    parts = [F.coalesce(F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in range(4)]
    return own.agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *parts), 256).alias("hash"))


def headline_table(fields: DataFrame, groups: DataFrame, routing: DataFrame, calibration: list[DataFrame]) -> DataFrame:
    """metric, value of a run: from the measures of all observations (fields), the character error rate of each group
    (groups: grp, cer), the routing measures and one-row tables of calibration measures."""
    rename = {"hallucination": "hallucination_rate", "n_unreadable": "n_unreadable", "normalised": "normalized_match", "exact": "exact_match", "coverage": "coverage"}
    chosen = fields.select(*[F.col(c).cast("double").alias(n) for c, n in rename.items()])
    parts = [chosen, routing.select([F.col(c).cast("double").alias("sessions" if c == "n" else c) for c in routing.columns]), *calibration]
    long = groups.select(F.concat(F.lit("cer_"), "grp").alias("metric"), F.col("cer").alias("value"))
    for part in parts:
        long = long.unionByName(part.unpivot([], part.columns, "metric", "value"))
    return long
