"""Queries of the evaluation operators over documents and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.functions.text import character_error_rate
from fieldtrust.operators import calibrate as C
from fieldtrust.operators import evaluate as E
from fieldtrust.operators import merge as M
from fieldtrust.plans.base import Registry, for_spark, table

R = Registry()

SCORES = "SELECT d.doc_id AS id, (d.n_chars % 1000) / 1000.0E0 AS p, CAST(l.quality AS BIGINT) AS y, d.lang AS grp FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"

OBSERVED = """
SELECT id, id % 50 AS session_id, lang AS grp, source AS bucket, field, kind, truth, value, status, routed, required, lower(truth) AS norm_truth, lower(value) AS norm_value
FROM (SELECT doc_id AS id, lang, source, CASE doc_id % 4 WHEN 0 THEN 'names' WHEN 1 THEN 'digits' WHEN 2 THEN 'text' ELSE 'dates' END AS kind, CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'other' END AS field, doc_id % 2 = 0 AS required,
             doc_id % 7 < 3 AS routed, CASE WHEN doc_id % 5 = 0 THEN 'low_confidence' ELSE 'ok' END AS status,
             CASE WHEN doc_id % 9 = 0 THEN NULL ELSE w END AS truth,
             CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN w || 'x' WHEN doc_id % 4 = 2 THEN lower(w) WHEN doc_id % 4 = 3 THEN substring(w, 2) ELSE w END AS value
      FROM (SELECT doc_id, lang, source, 'T' || CAST(n_chars AS STRING) || source AS w FROM {documents}))
"""

CER = "CASE WHEN norm_truth = '' THEN CASE WHEN norm_value = '' THEN 0.0 ELSE 1.0 END ELSE levenshtein(norm_truth, norm_value) * 1.0 / length(norm_truth) END"
OBS = (
    "WITH fx AS (" + OBSERVED + "), obs AS (SELECT *, truth IS NOT DISTINCT FROM value AS exact, (truth IS NULL AND value IS NULL) OR coalesce(norm_truth = norm_value, false) AS correct, "
    f"CASE WHEN truth IS NOT NULL AND value IS NOT NULL THEN ({CER})::DOUBLE END AS cer FROM fx)"
)
MEASURES = (
    "count(*) AS n, round(avg(CASE WHEN truth IS NOT NULL THEN exact::INT END), 6) AS exact, round(avg(CASE WHEN truth IS NOT NULL THEN correct::INT END), 6) AS normalised, round(avg(CASE WHEN truth IS NOT NULL THEN (value IS NOT NULL)::INT END), 6) AS coverage, "
    "round(avg(cer), 6) AS cer, round(avg(CASE WHEN kind IN ('names', 'text') THEN cer END), 6) AS cer_text, round(avg(CASE WHEN kind = 'digits' THEN cer END), 6) AS cer_digits, round(avg(CASE WHEN value IS NULL THEN (truth IS NULL)::INT END), 6) AS null_precision, round(avg(CASE WHEN truth IS NULL THEN (value IS NULL)::INT END), 6) AS null_recall, "
    "round(avg(CASE WHEN truth IS NULL THEN (value IS NOT NULL)::INT END), 6) AS hallucination, count(CASE WHEN truth IS NULL THEN 1 END) AS n_unreadable, round(avg(CASE WHEN status = 'ok' AND value IS NOT NULL THEN correct::INT END), 6) AS ok_accuracy"
)
ROUNDED = ["exact", "normalised", "coverage", "cer", "cer_text", "cer_digits", "null_precision", "null_recall", "hallucination", "ok_accuracy"]


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return for_spark(spark, sf_dir, SCORES)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = for_spark(spark, sf_dir, OBSERVED)
    truth = rows.select("id", "session_id", "grp", "bucket", "field", "kind", "required", "routed", "truth", "norm_truth")
    seen = E.field_observations(truth, rows.select("id", "value", "norm_value", "status"), ["id"])
    return seen.withColumn("cer", F.when(F.col("truth").isNotNull() & F.col("value").isNotNull(), character_error_rate(F.col("norm_truth"), F.col("norm_value"))))


@R.add("evl_01_field_observations", OBS + " SELECT id, field, exact, correct, round(cer, 6) AS cer FROM obs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("id", "field", "exact", "correct", F.round("cer", 6).alias("cer"))


@R.add("evl_02_field_summary", OBS + f" SELECT grp, {MEASURES} FROM obs GROUP BY grp")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.field_summary(observations(spark, sf_dir), "grp"), *ROUNDED)


@R.add(
    "evl_03_sliced_summary",
    OBS + " SELECT CASE WHEN grouping(grp) = 0 THEN 'grp' WHEN grouping(bucket) = 0 THEN 'bucket' WHEN grouping(field) = 0 THEN 'field' ELSE 'overall' END AS slice, "
    f"coalesce(grp, bucket, field, 'all') AS slice_value, {MEASURES} FROM obs GROUP BY GROUPING SETS ((), (grp), (bucket), (field))",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.sliced_summary(observations(spark, sf_dir), ["grp", "bucket", "field"]), *ROUNDED)


BINS = "WITH fx AS (" + SCORES + "), b AS (SELECT *, ntile({{k}}) OVER (ORDER BY p, id) - 1 AS bin FROM fx), r AS (SELECT bin, avg(p) AS mean_p, avg(y) AS mean_y, count(*) AS n FROM b GROUP BY bin)"


@R.add("evl_04_ece", BINS.replace("{{k}}", "15") + " SELECT round(sum(n * abs(mean_p - mean_y)) / sum(n), 6) AS ece FROM r")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.calibration_error(E.reliability_bins(scores(spark, sf_dir), 15)), "ece")


@R.add("evl_05_brier", "WITH fx AS (" + SCORES + ") SELECT round(avg((p - y) * (p - y)), 6) AS brier FROM fx")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.brier(scores(spark, sf_dir)), "brier")


@R.add("evl_06_reliability_bins", BINS.replace("{{k}}", "10") + " SELECT bin::INT AS bin, round(mean_p, 6) AS mean_p, round(mean_y, 6) AS mean_y, n FROM r")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.reliability_bins(scores(spark, sf_dir), 10), "mean_p", "mean_y")


@R.add(
    "evl_07_selective_risk",
    "WITH fx AS (" + SCORES + "), t AS (SELECT i / 20.0E0 AS threshold FROM range(21) AS r(i)) SELECT threshold, round(count(*) * 1.0E0 / (SELECT count(*) FROM fx), 6) AS coverage, round(1 - avg(y), 6) AS error FROM t JOIN fx ON p >= threshold GROUP BY threshold",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.selective_risk(scores(spark, sf_dir)), "coverage", "error")


@R.add(
    "cal_05_choose_threshold",
    "WITH fx AS (" + SCORES + "), t AS (SELECT DISTINCT round(p, 4) AS tau FROM fx), s AS (SELECT tau, count(*) AS n, avg(y) AS pr FROM t JOIN fx ON p >= tau GROUP BY tau), g AS (SELECT min(tau) AS tau, arg_min(n, tau) AS n FROM s WHERE pr >= 0.9) "
    "SELECT coalesce(tau, 1.01) AS tau, round(coalesce(n * 1.0E0 / (SELECT count(*) FROM fx), 0.0), 6) AS coverage FROM g",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.choose_threshold(scores(spark, sf_dir), 0.9), "coverage")


@R.add(
    "cal_05_thresholds_by_group",
    "WITH fx AS (" + SCORES + "), t AS (SELECT DISTINCT grp, round(p, 4) AS tau FROM fx), s AS (SELECT t.grp, tau, count(*) AS n, avg(y) AS pr FROM t JOIN fx ON fx.grp = t.grp AND p >= tau GROUP BY ALL), g AS (SELECT grp, min(tau) AS tau, arg_min(n, tau) AS n FROM s WHERE pr >= 0.9 GROUP BY grp) "
    "SELECT a.grp, coalesce(tau, 1.01) AS tau, round(coalesce(n * 1.0E0 / total, 0.0), 6) AS coverage FROM (SELECT grp, count(*) AS total FROM fx GROUP BY grp) a LEFT JOIN g ON a.grp = g.grp",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.choose_thresholds(scores(spark, sf_dir), 0.9), "coverage")


FITS = "SELECT l_returnflag AS grp, l_quantity / 50.0E0 AS a, l_discount * 10.0E0 AS b, CASE WHEN (l_partkey * 7 + l_suppkey * 3 + CAST(l_quantity AS BIGINT) * 5) % 101 < 20 + CAST(l_quantity AS BIGINT) THEN 1 ELSE 0 END AS y FROM {lineitem}"
#: One Newton step in SQL: sums by group, then the three unknowns by Cramer's rule.
NEWTON = """,
s{n} AS MATERIALIZED (SELECT fx.grp, any_value(u) AS u, any_value(v) AS v, any_value(w) AS w, sum(e * a) + any_value(u) AS g1, sum(e * b) + any_value(v) AS g2, sum(e) AS g3,
    sum(q * a * a) + 1 AS h11, sum(q * a * b) AS h12, sum(q * a) AS h13, sum(q * b * b) + 1 AS h22, sum(q * b) AS h23, sum(q) AS h33
    FROM (SELECT fx.*, u, v, w, 1 / (1 + exp(-(u * a + v * b + w))) - y AS e, exp(-(u * a + v * b + w)) / pow(1 + exp(-(u * a + v * b + w)), 2) AS q FROM fx JOIN m{n} m ON fx.grp = m.grp) fx GROUP BY fx.grp),
m{m} AS MATERIALIZED (SELECT grp, u - (g1 * (h22 * h33 - h23 * h23) - h12 * (g2 * h33 - h23 * g3) + h13 * (g2 * h23 - h22 * g3)) / d AS u,
    v - (h11 * (g2 * h33 - h23 * g3) - g1 * (h12 * h33 - h23 * h13) + h13 * (h12 * g3 - g2 * h13)) / d AS v, w - (h11 * (h22 * g3 - g2 * h23) - h12 * (h12 * g3 - g2 * h13) + g1 * (h12 * h23 - h22 * h13)) / d AS w
    FROM (SELECT *, h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13) AS d FROM s{n}))"""


@R.add(
    "cal_02_fit_logistic",
    "WITH fx AS MATERIALIZED (" + FITS + "), m0 AS MATERIALIZED (SELECT DISTINCT grp, 0.0E0 AS u, 0.0E0 AS v, 0.0E0 AS w FROM fx)" + "".join(NEWTON.replace("{n}", str(i)).replace("{m}", str(i + 1)) for i in range(8)) + " SELECT grp, round(u, 5) AS weight_a, round(v, 5) AS weight_b, round(w, 5) AS bias FROM m8",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = for_spark(spark, sf_dir, FITS).select("grp", F.array(F.col("a").cast("double"), F.col("b").cast("double")).alias("vector"), "y")
    return C.fit_logistic(rows).select("grp", F.round(F.get("weights", F.lit(0)), 5).alias("weight_a"), F.round(F.get("weights", F.lit(1)), 5).alias("weight_b"), F.round("bias", 5).alias("bias"))


RAW = "SELECT l_linestatus AS grp, CAST((l_partkey * 13 + l_suppkey) % 200 AS BIGINT) AS k, CASE WHEN (l_orderkey * 31 + l_linenumber * 17) % 200 < (l_partkey * 13 + l_suppkey) % 200 THEN 1 ELSE 0 END AS y FROM {lineitem}"


@R.add(
    "cal_03_fit_isotonic",
    # the fitted value is the largest, over the points up to its own, of the smallest mean that begins there and reaches beyond it
    "WITH v AS (SELECT grp, k, count(*) AS n, sum(y) AS s FROM (" + RAW + ") GROUP BY ALL), c AS (SELECT grp, k, sum(n) OVER w AS nn, sum(s) OVER w AS ss, n, s FROM v WINDOW w AS (PARTITION BY grp ORDER BY k)), "
    "m AS (SELECT i.grp, i.k, h.k AS upto, (h.ss - i.ss + i.s) * 1.0E0 / (h.nn - i.nn + i.n) AS mean FROM c i JOIN c h ON h.grp = i.grp AND h.k >= i.k), "
    "f AS (SELECT grp, k, upto, min(mean) OVER (PARTITION BY grp, k ORDER BY upto DESC) AS least FROM m) SELECT grp, upto / 200.0E0 AS p, round(max(least), 6) AS fitted FROM f GROUP BY grp, upto",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = for_spark(spark, sf_dir, RAW).select("grp", (F.col("k") / 200.0).alias("p"), "y")
    knots = C.fit_isotonic(points)
    asked = points.select("grp", "p").distinct().join(F.broadcast(knots), "grp")  # one row of knots for each of two groups
    return asked.select("grp", "p", F.round(M.interpolated(F.col("p"), F.col("iso_x"), F.col("iso_y")), 6).alias("fitted"))


@R.add("cal_07_calibration_summary", "WITH fx AS (" + SCORES + ") SELECT grp, count(*) AS n, round(avg((p >= 0.5)::INT), 6) AS coverage, round(avg(CASE WHEN p >= 0.5 THEN y END), 6) AS precision_at_tau FROM fx GROUP BY grp")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = F.col("p") >= 0.5
    found = scores(spark, sf_dir).groupBy("grp").agg(F.count("*").alias("n"), E.share(accepted).alias("coverage"), F.avg(F.when(accepted, F.col("y"))).alias("precision_at_tau"))
    return rounded(found, "coverage", "precision_at_tau")


ROUTES = OBS + ", ses AS (SELECT session_id, bool_or(required AND (NOT correct OR truth IS NULL)) AS needed, bool_or(routed AND id % 3 = 0) AS routed FROM obs GROUP BY session_id)"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    routed = obs.groupBy("session_id").agg(F.bool_or(F.col("routed") & (F.col("id") % 3 == 0)).alias("routed"))
    return E.session_observations(obs).join(routed, "session_id")


@R.add(
    "evl_08_routing_metrics",
    ROUTES + " SELECT count(*) AS n, round(avg(routed::INT), 6) AS review_rate, round(sum((routed AND needed)::INT) * 1.0E0 / nullif(sum(routed::INT), 0), 6) AS precision, round(sum((routed AND needed)::INT) * 1.0E0 / nullif(sum(needed::INT), 0), 6) AS recall, "
    "round(2.0E0 * sum((routed AND needed)::INT) / nullif(sum(routed::INT) + sum(needed::INT), 0), 6) AS f1, round(avg((NOT routed)::INT), 6) AS auto_pass_rate, round(avg(CASE WHEN NOT routed THEN needed::INT END), 6) AS auto_pass_error FROM ses",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.routing_metrics(sessions(spark, sf_dir)), "review_rate", "precision", "recall", "f1", "auto_pass_rate", "auto_pass_error")


@R.add(
    "evl_09_variant_recall",
    "WITH v AS (SELECT unnest(['v' || (o_orderkey % 3), 'w' || (o_orderkey % 4)]) AS variant, o_orderstatus = 'F' AS routed FROM {orders}) SELECT variant, count(*) AS n, round(avg(routed::INT), 6) AS routed FROM v GROUP BY variant",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    name = lambda p, m: F.concat(F.lit(p), (F.col("o_orderkey") % m).cast("string"))
    rows = orders.select(F.array(name("v", 3), name("w", 4)).alias("variants"), (F.col("o_orderstatus") == "F").alias("routed"))
    return rounded(E.variant_recall(rows), "routed")


@R.add(
    "evl_13_sample_per_type",
    "WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('s' || c_custkey), c_custkey) AS k FROM {customer}) SELECT c_custkey, c_mktsegment FROM r WHERE k <= 15",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sample_per_type(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 15, "s")


@R.add(
    "evl_14_assign_splits",
    "WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('s' || c_custkey), c_custkey) AS k, count(*) OVER () AS n FROM {customer}) SELECT c_custkey, CASE WHEN k <= round(n * 0.6) THEN 'tune' WHEN k <= round(n * 0.6) + round(n * 0.2) THEN 'calibration' ELSE 'test' END AS split FROM r",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.assign_splits(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "s")


@R.add(
    "evl_15_manifest_hash",
    "WITH h AS (SELECT sha256(c_custkey || chr(31) || c_mktsegment) AS h FROM {customer}) SELECT sha256(count(*) || ',' || "
    + " || ',' || ".join(f"CAST(sum(CAST(('0x' || substring(h, {1 + 15 * k}, 15)) AS BIGINT)::HUGEINT) AS VARCHAR)" for k in range(4))
    + ") AS hash FROM h",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.table_hash(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))


#: Every seventh session has no output; others are routed by their number.
ROUTED = "SELECT DISTINCT doc_id % 50 AS session_id, doc_id % 50 % 3 = 0 AS routed, doc_id % 50 % 4 = 0 AS human_expected FROM {documents} WHERE doc_id % 50 % 7 <> 0"


@R.add(
    "evl_17_session_scores",
    OBS + ", ro AS (" + ROUTED + "), s AS (SELECT session_id, round(avg(correct::INT), 6) AS field_score, string_agg(CASE WHEN NOT correct THEN field END, ',' ORDER BY field) AS wrong, string_agg(CASE WHEN truth IS NULL AND value IS NOT NULL THEN field END, ',' ORDER BY field) AS invented, "
    "round(coalesce(avg(CASE WHEN truth IS NULL THEN (value IS NULL)::INT END), 1), 6) AS hallucination_score, string_agg(CASE WHEN NOT correct AND required THEN field END, ',' ORDER BY field) AS required_wrong, bool_or(truth IS NULL) AS unreadable FROM obs GROUP BY session_id) "
    "SELECT s.session_id, field_score, coalesce(wrong, '') AS wrong, coalesce(invented, '') AS invented, hallucination_score, coalesce(required_wrong, '') AS required_wrong, routed, coalesce(human_expected, false) OR required_wrong IS NOT NULL OR unreadable AS human_needed, "
    "CASE WHEN routed = (coalesce(human_expected, false) OR required_wrong IS NOT NULL OR unreadable) THEN 1.0E0 ELSE 0.0E0 END AS routing_score FROM s LEFT JOIN ro ON ro.session_id = s.session_id",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rounded(E.session_scores(observations(spark, sf_dir), for_spark(spark, sf_dir, ROUTED)), "field_score", "hallucination_score")
    return found.withColumns({c: F.array_join(c, ",") for c in ("wrong", "invented", "required_wrong")})


@R.add("evl_18_average_score", OBS + ", s AS (SELECT session_id, CASE WHEN session_id % 5 = 0 THEN NULL ELSE avg(correct::INT) END AS v FROM obs GROUP BY session_id) SELECT round(avg(coalesce(v, 0)), 4) AS score FROM s")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.session_scores(observations(spark, sf_dir)).select(F.when(F.col("session_id") % 5 != 0, F.col("field_score")).alias("v"))
    return found.agg(F.round(F.avg(F.coalesce("v", F.lit(0.0))), 4).alias("score"))


HEADLINE = (
    ROUTES + ", "
    + BINS.replace("{{k}}", "15").removeprefix("WITH ").replace("fx AS", "sc AS", 1).replace("FROM fx", "FROM sc")
    + ", br AS (SELECT avg((p - y) * (p - y)) AS brier FROM sc), f AS (SELECT avg(CASE WHEN truth IS NULL THEN (value IS NOT NULL)::INT END) AS hallucination_rate, count(CASE WHEN truth IS NULL THEN 1 END)::DOUBLE AS n_unreadable, avg(CASE WHEN truth IS NOT NULL THEN correct::INT END) AS normalized_match, avg(CASE WHEN truth IS NOT NULL THEN exact::INT END) AS exact_match, avg(CASE WHEN truth IS NOT NULL THEN (value IS NOT NULL)::INT END) AS coverage FROM obs), "
    "ro AS (SELECT count(*)::DOUBLE AS sessions, avg(routed::INT) AS review_rate, sum((routed AND needed)::INT) * 1.0E0 / nullif(sum(routed::INT), 0) AS precision, sum((routed AND needed)::INT) * 1.0E0 / nullif(sum(needed::INT), 0) AS recall, "
    "2.0E0 * sum((routed AND needed)::INT) / nullif(sum(routed::INT) + sum(needed::INT), 0) AS f1, avg((NOT routed)::INT) AS auto_pass_rate, avg(CASE WHEN NOT routed THEN needed::INT END) AS auto_pass_error FROM ses), "
    "ec AS (SELECT sum(n * abs(mean_p - mean_y)) / sum(n) AS ece FROM r), "
    "t AS (SELECT 'cer_' || grp AS metric, avg(cer) AS value FROM obs GROUP BY grp "
    + "".join(f"UNION ALL SELECT '{m}', {m} FROM {t} " for t, names in (("f", ["hallucination_rate", "n_unreadable", "normalized_match", "exact_match", "coverage"]), ("ro", ["sessions", "review_rate", "precision", "recall", "f1", "auto_pass_rate", "auto_pass_error"]), ("ec", ["ece"]), ("br", ["brier"])) for m in names)
    + ") SELECT metric, round(value, 6) AS value FROM t"
)


@R.add("evl_19_headline_table", HEADLINE)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs, p = observations(spark, sf_dir), scores(spark, sf_dir)
    calibration = [E.calibration_error(E.reliability_bins(p)), E.brier(p)]
    return rounded(E.headline_table(E.field_summary(obs), E.field_summary(obs, "grp"), E.routing_metrics(sessions(spark, sf_dir)), calibration), "value")
