"""From readings of several readers to one value, a confidence and a status for each field.

Input rows: session_id, slot, field, grp (names, digits, dates, enums or text), reader, ord (the reader's configured
place, 0 first), sample, status (ok or the reader's failure), value, reason, line_conf. Everything is keyed by session,
so one shuffle by session_id serves all groupings here and the decision after them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.functions.text import let, similarity, with_normalized

KEY = ["session_id", "slot", "field", "grp"]
#: Similarity to a cluster's first member from which a reading joins it.
SAME = 0.9
# fixed values: the model used before any calibration
FEATURES = ["agreement", "pair_similarity", "self_consistency", "readers_ok", "illegible", "format_valid", "glare", "blur", "handwritten", "logprob"]
IMPUTED = {"self_consistency": 0.5, "format_valid": 0.5, "logprob": 0.5}
WEIGHTS, BIAS, THRESHOLD = [7.0, 2.0, 1.5, 1.0, -4.0, 2.0, -2.0, -2.0, -0.5, 0.0], -6.5, 0.9


def by_session(readings: DataFrame) -> DataFrame:
    """The one shuffle; groupings by session and more columns need no other."""
    return readings.repartition("session_id")


def reader_status(readings: DataFrame) -> DataFrame:
    """session_id, slot, reader, status: ok if any sample is, else the first sample's."""
    own = readings.groupBy("session_id", "slot", "reader").agg(F.bool_or(F.col("status") == "ok").alias("any_ok"), F.min_by("status", "sample").alias("first"))
    return own.select("session_id", "slot", "reader", F.when(F.col("any_ok"), "ok").otherwise(F.col("first")).alias("status"))


def reader_mode(readings: DataFrame, norm: Column | None = None) -> DataFrame:
    """One row for each reader that answered: its most frequent value (null is a vote; ties: the earliest sample), its
    canonical form, and the share of its samples that agree (null with a single sample)."""
    ok = readings.where("status = 'ok'")
    ok = with_normalized(ok, "value", "norm") if norm is None else ok.withColumn("norm", norm)
    ok = ok.withColumn("norm", F.when(F.col("value").isNotNull(), F.col("norm")))
    votes = ok.groupBy(*KEY, "reader", "ord", "norm").agg(F.count("*").alias("n"), F.min("sample").alias("first"), F.min_by("value", "sample").alias("value"), F.bool_or(F.col("reason").eqNullSafe("illegible")).alias("illegible"), F.collect_set("reason").alias("reasons"), F.sum("line_conf").alias("conf_sum"), F.count("line_conf").alias("conf_n"))
    return votes.groupBy(*KEY, "reader", "ord").agg(
        F.max_by(F.struct("value", "norm"), F.struct("n", -F.col("first"))).alias("best"),
        (F.when(F.sum("n") > 1, F.max("n") / F.sum("n"))).alias("consistency"),
        F.bool_or("illegible").alias("illegible"),
        F.flatten(F.collect_list("reasons")).alias("reasons"),
        F.sum("conf_sum").alias("conf_sum"),
        F.sum("conf_n").alias("conf_n"),
    ).select(*KEY, "reader", "ord", F.col("best.value").alias("value"), F.col("best.norm").alias("norm"), "consistency", "illegible", "reasons", "conf_sum", "conf_n")


def modes(reads: Column) -> Column:
    """reader_mode for the readings of one field as an array (structs with ord, reader, sample, value, norm, day): each
    reader's struct(ord, reader, value, norm, day, consistency)."""

    def mode(k: Column, own: Column) -> Column:
        alike = lambda r: F.size(F.filter(own, lambda q: q["norm"].eqNullSafe(r["norm"])))
        counted = F.transform(own, lambda r: F.struct(alike(r).alias("n"), (-r["sample"]).alias("first"), r["value"].alias("value"), r["norm"].alias("norm"), r["day"].alias("day")))
        shown = lambda b: F.struct(k["ord"].alias("ord"), k["reader"].alias("reader"), b["value"].alias("value"), b["norm"].alias("norm"), b["day"].alias("day"), F.when(F.size(own) > 1, b["n"] / F.size(own)).alias("consistency"))
        return let(F.array_max(counted), shown)

    who = F.array_distinct(F.transform(reads, lambda r: F.struct(r["ord"].alias("ord"), r["reader"].alias("reader"))))
    return F.transform(who, lambda k: let(F.filter(reads, lambda r: r["ord"].eqNullSafe(k["ord"]) & r["reader"].eqNullSafe(k["reader"])), lambda own: mode(k, own)))


def clusters(votes: Column) -> Column:
    """Votes (ordered structs with norm) in clusters: each joins the first one whose first member is alike."""

    def place(state: Column, vote: Column) -> Column:
        alike = lambda i: F.coalesce(similarity(F.get(F.get(state, i), F.lit(0))["norm"], vote["norm"]) >= SAME, F.lit(False))
        hit = F.filter(F.sequence(F.lit(0), F.size(state)), alike)
        return let(F.get(hit, F.lit(0)), lambda at: F.when(at.isNull(), F.array_append(state, F.array(vote))).otherwise(F.transform(state, lambda own, i: F.when(i == at, F.array_append(own, vote)).otherwise(own))))

    return let(votes, lambda v: F.aggregate(v, F.slice(F.array(v), 1, 0), place))


def voted(modes: DataFrame, configured: int, primary: str | Column) -> DataFrame:
    """One row for each field with the winning cluster: (size, holds the primary reader, holds a value that is not
    invalid), the first of equals. modes: reader_mode with `valid` (null: no rule). primary may depend on the key columns."""
    vote = F.struct("ord", "reader", "value", "norm", "valid")
    fields = modes.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.when(F.col("value") != "", vote))).alias("votes"),
        F.collect_list(F.struct("ord", "norm")).alias("all_votes"),
        F.count("*").alias("n_ok"),
        F.avg("consistency").alias("consistency"),
        F.bool_or("illegible").alias("illegible"),
        F.array_distinct(F.flatten(F.collect_list("reasons"))).alias("reasons"),
        (F.sum("conf_sum") / F.sum("conf_n")).alias("logprob"),
    )
    return elected(fields, configured, primary, KEY)


def elected(fields: DataFrame, configured: int, primary: str | Column, keep: list[str], of_chosen: list[str] | None = None) -> DataFrame:
    """What voted returns, from each field's votes and all_votes (arrays), n_ok, consistency, illegible, reasons and logprob,
    with the columns to keep and further parts of the chosen vote."""
    ranked = F.transform(clusters(F.col("votes")), lambda c, i: F.struct(F.size(c).alias("size"), F.exists(c, lambda v: v["reader"] == primary).alias("has_primary"), F.exists(c, lambda v: F.coalesce(v["valid"], F.lit(True))).alias("any_valid"), (-i).alias("order"), c.alias("members")))
    found = fields.withColumn("ranked", ranked).withColumn("winner", F.array_max("ranked")).withColumn("n_clusters", F.size("ranked"))
    chosen = F.coalesce(F.get(F.filter("winner.members", lambda v: v["reader"] == primary), F.lit(0)), F.get("winner.members", F.lit(0)))
    found = found.withColumns({"chosen": chosen, "n_winner": F.coalesce("winner.size", F.lit(0))})
    outside = F.filter("all_votes", lambda v: ~F.exists(F.col("winner.members"), lambda w: w["ord"] == v["ord"]))
    nearest = F.array_min(F.transform(outside, lambda v: F.when(v["norm"].isNull() | (v["norm"] == ""), 0.0).otherwise(similarity(F.col("chosen.norm"), v["norm"]))))
    pair = F.coalesce(nearest, F.lit(1.0)) if configured > 1 else F.lit(0.0)
    return found.select(
        *keep, F.col("chosen.value").alias("value"), F.col("chosen.valid").alias("valid"), *[F.col("chosen")[c].alias(c) for c in of_chosen or []], "n_clusters", "n_winner", "n_ok", "illegible", "reasons",
        F.forall("votes", lambda v: v["valid"].eqNullSafe(F.lit(False))).alias("all_invalid"),
        (F.col("n_winner") / max(configured, 1)).alias("agreement"), pair.alias("pair_similarity"),
        F.coalesce("consistency", F.lit(0.5)).alias("self_consistency"), (F.col("n_ok") / max(configured, 1)).alias("readers_ok"),
        F.coalesce("logprob", F.lit(0.5)).alias("logprob"),
    )


def with_features(fields: DataFrame) -> DataFrame:
    """Adds the map of features; glare, blur and handwritten come from columns of these names where there are any."""
    given = lambda n: F.coalesce(F.col(n), F.lit(0.0)).cast("double") if n in fields.columns else F.lit(0.0)
    values = {
        **{n: F.col(n) for n in ("agreement", "pair_similarity", "self_consistency", "readers_ok", "logprob")},
        "illegible": F.col("illegible").cast("double"),
        "format_valid": F.when(F.col("valid").isNull(), 0.5).otherwise(F.col("valid").cast("double")),
        **{n: given(n) for n in ("glare", "blur", "handwritten")},
    }
    return fields.withColumn("features", F.create_map(*[x for n in FEATURES for x in (F.lit(n), values[n].cast("double"))]))


def feature_vector(features: Column) -> Column:
    return F.array(*[F.coalesce(F.try_element_at(features, F.lit(n)), F.lit(IMPUTED.get(n, 0.0))) for n in FEATURES])


def interpolated(p: Column, xs: Column, ys: Column) -> Column:
    """Piecewise linear through the knots, flat outside them."""

    def of(below: Column) -> Column:
        at, after = F.size(below) - 1, F.size(below)
        x0, x1, y0, y1 = F.get(xs, at), F.get(xs, after), F.get(ys, at), F.get(ys, after)
        between = F.when(x1 == x0, y1).otherwise(y0 + (y1 - y0) * (p - x0) / (x1 - x0))
        return F.when(F.size(below) == 0, F.get(ys, F.lit(0))).when(after >= F.size(xs), F.element_at(ys, -1)).otherwise(between)

    return let(F.filter(xs, lambda x: x <= p), of)


def scored(vector: Column, weights: Column | None = None, bias: Column | float = BIAS, xs: Column | None = None, ys: Column | None = None) -> Column:
    """Probability that a value is right: logistic, through the calibration knots if given, rounded to 4 places."""
    w = F.array(*map(F.lit, WEIGHTS)) if weights is None else weights
    z = F.aggregate(F.zip_with(w, vector, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) + bias
    p = let(1 / (1 + F.exp(-z)), lambda q: q if xs is None else F.when(F.size(xs) > 0, interpolated(q, xs, ys)).otherwise(q))
    return F.round(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)), 4)


def with_status(fields: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds the final value, confidence, status and reason. A value is withheld, never invented, where readers disagree
    without a valid reading or some found it illegible."""
    none = F.col("value").isNull()
    scored_ = fields.withColumn("p", scored(feature_vector(F.col("features"))))
    split = (F.col("n_clusters") > 1) & F.col("all_invalid")
    unsure = F.col("illegible") & (F.col("n_winner") < F.col("n_ok"))
    absent = F.size(F.array_except("reasons", F.array(F.lit("not_present")))) == 0
    outcome = (
        F.when(none & (F.col("n_ok") == 0), _outcome("unreadable", "no reader available", False))
        .when(none & F.col("illegible"), _outcome("unreadable", "illegible characters", False))
        .when(none & absent, _outcome("not_present", "not present on the document", False))
        .when(none, _outcome("unreadable", "no verbatim reading", False))
        .when(split, _outcome("low_confidence", "readers disagree and no reading passes validation", False))
        .when(unsure, _outcome("unreadable", "illegible for some readers; others disagree", False))
        .when(F.col("valid").eqNullSafe(F.lit(False)), _outcome("invalid_format", "format check failed", True))
        .when((F.col("p") < threshold) & (F.col("n_clusters") > 1), _outcome("low_confidence", "readers disagree", True))
        .when(F.col("p") < threshold, _outcome("low_confidence", "below confidence threshold", True))
        .otherwise(_outcome("ok", None, True))
    )
    # explode keeps the optimizer from repeating these expressions in every later filter and projection
    final = F.struct(F.when(outcome["keep"], F.col("value")).alias("value"), F.when(none, 0.0).otherwise(F.col("p")).alias("confidence"), outcome["status"].alias("status"), outcome["reason"].alias("reason"))
    return scored_.withColumn("final", F.explode(F.array(final))).drop("value", "p").select("*", "final.*").drop("final")


def _outcome(status: str, reason: str | None, keep: bool) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"), F.lit(keep).alias("keep"))


def run_provenance(reads: Column) -> Column:
    """provenance for the readings of one field as an array in the order of readers and samples: a struct of the same."""
    name = lambda r: F.concat_ws("#", r["reader"], r["sample"].cast("string"))
    entries = lambda c, test: F.map_from_entries(F.transform(F.filter(reads, test), lambda r: F.struct(name(r), r[c])))
    first = lambda test: F.get(F.filter(reads, test), F.lit(0))
    box = let(first(lambda r: r["x0"].isNotNull()), lambda r: F.when(r.isNotNull(), F.struct(*[r[c].alias(c) for c in ("x0", "y0", "x1", "y1")])))
    return F.struct(
        entries("value", lambda r: r["value"].isNotNull()).alias("candidates"),
        entries("lines", lambda r: F.size(r["lines"]) > 0).alias("sources"),
        box.alias("box"),
        first(lambda r: r["raw_partial"].isNotNull())["raw_partial"].alias("raw_partial"),
    )


def provenance(readings: DataFrame) -> DataFrame:
    """session_id, slot, field, candidates (MAP of reader#sample to its value), sources (MAP of reader#sample to the lines its
    value stands in), box (x0 y0 x1 y1) and raw_partial of the first reading that has one, in the readers' order.

    readings: of readers that answered, with lines ARRAY, x0 y0 x1 y1 and raw_partial; a reader's sample reads a field once.
    A field holds as many entries as it has runs, a handful."""
    name = F.concat_ws("#", "reader", F.col("sample").cast("string")).alias("name")
    runs = F.array_sort(F.collect_list(F.struct("ord", "sample", name, "value", "lines")))
    first = lambda what, test: F.min_by(what, F.when(test, F.struct("ord", "sample")))
    grouped = readings.where("status = 'ok'").groupBy("session_id", "slot", "field").agg(runs.alias("runs"), first(F.struct("x0", "y0", "x1", "y1"), F.col("x0").isNotNull()).alias("box"), first("raw_partial", F.col("raw_partial").isNotNull()).alias("raw_partial"))
    entries = lambda c, test: F.map_from_entries(F.transform(F.filter("runs", test), lambda r: F.struct(r["name"], r[c])))
    return grouped.select("session_id", "slot", "field", entries("value", lambda r: r["value"].isNotNull()).alias("candidates"), entries("lines", lambda r: F.size(r["lines"]) > 0).alias("sources"), "box", "raw_partial")


def medoid(votes: Column, n_readers: int) -> Column:
    """struct(value, agreement): of the votes in order the one that most others agree with, the first of equals."""
    counts = F.transform(votes, lambda v, i: F.struct(F.size(F.filter(votes, lambda w: similarity(v["norm"], w["norm"]) >= SAME)).alias("n"), (-i).alias("order"), v["value"].alias("value")))
    return let(F.array_max(counts), lambda b: F.when(b.isNotNull(), F.struct(b["value"].alias("value"), (b["n"] / n_readers).alias("agreement"))))
