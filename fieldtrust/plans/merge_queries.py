"""Queries of the merge, validation and decision operators over readings derived from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.operators import decide as D
from fieldtrust.operators import merge as M
from fieldtrust.plans.base import Registry, for_spark

R = Registry()

READINGS = """
SELECT k AS session_id, 'order' AS slot, field, grp, reader, ord, sample,
       CASE WHEN reader = 'c' AND k % 4 = 0 THEN 'unavailable' ELSE 'ok' END AS status,
       CASE WHEN reader = 'c' AND k % 6 = 1 THEN NULL
            WHEN field = 'number' AND reader IN ('a', 'b') AND k % 13 = 5 THEN NULL
            WHEN reader = 'a' AND k % 7 = 2 THEN '9' || substring(v, 2)
            WHEN reader = 'b' AND sample = 1 AND k % 10 = 3 THEN substring(v, 1, length(v) - 1)
            ELSE v END AS value,
       CASE WHEN reader = 'c' AND k % 6 = 1 THEN 'not_present'
            WHEN field = 'number' AND reader IN ('a', 'b') AND k % 13 = 5 THEN 'illegible' END AS reason,
       CAST(NULL AS DOUBLE) AS line_conf
FROM (SELECT o_orderkey AS k, f.field, f.grp, r.reader, r.ord, r.sample,
             CASE f.field WHEN 'priority' THEN o_orderpriority
                          WHEN 'placed' THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
                          ELSE lpad(CAST(o_orderkey AS STRING), 12, '0') END AS v
      FROM {orders}
      CROSS JOIN (VALUES ('priority', 'enums'), ('placed', 'dates'), ('number', 'digits')) AS f(field, grp)
      CROSS JOIN (VALUES ('a', 0, 0), ('b', 1, 0), ('b', 1, 1), ('b', 1, 2), ('c', 2, 0)) AS r(reader, ord, sample))
"""

#: The format rule of the number field, and what dates look like.
NUMBER, DAY = r"^[0-8]\d{11}$", r"^\d{4}-\d{2}-\d{2}$"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.by_session(for_spark(spark, sf_dir, READINGS))


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.reader_mode(readings(spark, sf_dir), F.lower("value"))
    rule = F.when(F.col("field") == "number", F.col("value").rlike(NUMBER)).when(F.col("field") == "placed", F.col("value").rlike(DAY))
    return found.withColumn("valid", F.when(F.col("value").isNotNull(), rule))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.with_features(M.voted(modes(spark, sf_dir), 3, "a"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.with_status(merged(spark, sf_dir))
    order = F.when(F.col("field") == "priority", 0).when(F.col("field") == "placed", 1).otherwise(2)
    return out.withColumns({"required": F.lit(True), "slot_order": F.lit(0), "field_order": order})


MODES = (
    "WITH fx AS (" + READINGS + "), votes AS (SELECT session_id, field, reader, ord, lower(value) AS norm, count(*) AS n, min(sample) AS first, "
    "arg_min(value, sample) AS value, bool_or(coalesce(reason, '') = 'illegible') AS illegible, bool_or(reason IS NOT NULL AND reason <> 'not_present') AS other "
    "FROM fx WHERE status = 'ok' GROUP BY ALL), "
    "modes AS (SELECT session_id, field, reader, ord, value, norm, sum(n) OVER w AS total, n, bool_or(illegible) OVER w AS illegible, bool_or(other) OVER w AS other, "
    "row_number() OVER (PARTITION BY session_id, field, reader ORDER BY n DESC, first) AS rk FROM votes WINDOW w AS (PARTITION BY session_id, field, reader)), "
    "best AS (SELECT session_id, field, reader, ord, value, norm, illegible, other, CASE WHEN total > 1 THEN n * 1.0 / total END AS consistency, "
    "CASE WHEN value IS NULL THEN NULL WHEN field = 'number' THEN regexp_matches(value, '^[0-8][0-9]{{11}}$') "
    "WHEN field = 'placed' THEN regexp_matches(value, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') END AS valid FROM modes WHERE rk = 1)"
)

SIM = "CASE WHEN {0} = {1} THEN 1.0 WHEN {0} = '' OR {1} = '' THEN 0.0 ELSE 1 - levenshtein({0}, {1}) * 1.0 / greatest(length({0}), length({1})) END"


def sim(a: str, b: str) -> str:
    return SIM.replace("{0}", a).replace("{1}", b)


#: One row for each field with the three readers' votes side by side, and the cluster (1 to 3) of each.
VOTED = (
    MODES
    + ", wide AS (SELECT session_id, field, "
    + ", ".join(f"max(CASE WHEN reader = '{r}' THEN {c} END) AS {c}_{r}" for r in "abc" for c in ("value", "norm"))
    + ", "
    + ", ".join(f"bool_or(reader = '{r}' AND coalesce(valid, true)) AS fit_{r}, bool_or(reader = '{r}' AND valid = false) AS bad_{r}, bool_or(reader = '{r}') AS has_{r}" for r in "abc")
    + ", count(*) AS n_ok, avg(consistency) AS consistency, bool_or(illegible) AS illegible, bool_or(other) AS other FROM best GROUP BY session_id, field), "
    + "placed AS (SELECT *, CASE WHEN norm_a IS NOT NULL THEN 1 END AS ca, "
    + f"CASE WHEN norm_b IS NULL THEN NULL WHEN norm_a IS NOT NULL AND {sim('norm_a', 'norm_b')} >= 0.9 THEN 1 ELSE 2 END AS cb FROM wide), "
    + f"grouped AS (SELECT *, CASE WHEN norm_c IS NULL THEN NULL WHEN ca = 1 AND {sim('norm_a', 'norm_c')} >= 0.9 THEN 1 "
    + f"WHEN cb = 2 AND {sim('norm_b', 'norm_c')} >= 0.9 THEN 2 ELSE 3 END AS cc FROM placed), "
    + "sized AS (SELECT *, "
    + ", ".join(f"(coalesce(ca = {i}, false)::INT + coalesce(cb = {i}, false)::INT + coalesce(cc = {i}, false)::INT) AS s{i}, (coalesce(ca = {i} AND fit_a, false) OR coalesce(cb = {i} AND fit_b, false) OR coalesce(cc = {i} AND fit_c, false))::INT AS v{i}" for i in (1, 2, 3))
    + " FROM grouped), "
    + "won AS (SELECT *, (s1 > 0)::INT + (s2 > 0)::INT + (s3 > 0)::INT AS n_clusters, "
    + "CASE WHEN s1 + s2 + s3 = 0 THEN NULL WHEN s1 >= s2 AND s1 >= s3 THEN CASE WHEN s1 > 0 THEN 1 END "
    + "WHEN (s2, v2) >= (s3, v3) THEN 2 ELSE 3 END AS w FROM sized), "
    + "voted AS (SELECT *, CASE WHEN ca = w THEN value_a WHEN cb = w THEN value_b WHEN cc = w THEN value_c END AS value, "
    + "CASE WHEN ca = w THEN norm_a WHEN cb = w THEN norm_b WHEN cc = w THEN norm_c END AS norm, "
    + "CASE WHEN ca = w THEN CASE WHEN bad_a THEN false WHEN field <> 'priority' THEN true END WHEN cb = w THEN CASE WHEN bad_b THEN false WHEN field <> 'priority' THEN true END "
    + "WHEN cc = w THEN CASE WHEN bad_c THEN false WHEN field <> 'priority' THEN true END END AS valid, "
    + "coalesce(CASE w WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN s3 END, 0) AS n_winner FROM won), "
    + "feats AS (SELECT *, n_winner / 3.0 AS agreement, least("
    + ", ".join(f"CASE WHEN has_{r} AND (c{r} IS NULL OR c{r} <> w) THEN CASE WHEN norm_{r} IS NULL THEN 0.0 ELSE {sim('norm', 'norm_' + r)} END ELSE 1.0 END" for r in "abc")
    + ") AS pair_similarity, coalesce(consistency, 0.5) AS self_consistency, n_ok / 3.0 AS readers_ok, "
    + "CASE WHEN valid IS NULL THEN 0.5 WHEN valid THEN 1.0 ELSE 0.0 END AS format_valid FROM voted), "
    + "scored AS (SELECT *, round(1 / (1 + exp(-(7 * agreement + 2 * pair_similarity + 1.5 * self_consistency + readers_ok - 4 * illegible::INT + 2 * format_valid - 6.5))), 4) AS p FROM feats), "
    + "final AS (SELECT *, CASE WHEN value IS NULL AND illegible THEN 'unreadable' WHEN value IS NULL AND NOT other THEN 'not_present' WHEN value IS NULL THEN 'unreadable' "
    + "WHEN n_clusters > 1 AND coalesce(norm_a IS NULL OR bad_a, true) AND coalesce(norm_b IS NULL OR bad_b, true) AND coalesce(norm_c IS NULL OR bad_c, true) THEN 'low_confidence_withheld' "
    + "WHEN illegible AND n_winner < n_ok THEN 'unreadable' WHEN valid = false THEN 'invalid_format' WHEN p < 0.9 THEN 'low_confidence' ELSE 'ok' END AS st FROM scored), "
    + "fields AS (SELECT session_id, field, replace(st, '_withheld', '') AS status, CASE WHEN st IN ('invalid_format', 'low_confidence', 'ok') THEN value END AS value, "
    + "CASE WHEN value IS NULL THEN 0.0 ELSE p END AS confidence FROM final)"
)


@R.add("ext_10_reader_status", "WITH fx AS (" + READINGS + ") SELECT session_id, slot, reader, CASE WHEN bool_or(status = 'ok') THEN 'ok' ELSE arg_min(status, sample) END AS status FROM fx GROUP BY ALL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.reader_status(readings(spark, sf_dir))


@R.add("mrg_01_reader_mode", MODES + " SELECT session_id, field, reader, value, round(consistency, 6) AS consistency FROM best")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes(spark, sf_dir).select("session_id", "field", "reader", "value", F.round("consistency", 6).alias("consistency"))


@R.add("mrg_02_cluster_votes", VOTED + " SELECT session_id, field, value, n_clusters::INT AS n_clusters, n_winner::INT AS n_winner FROM voted")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.voted(modes(spark, sf_dir), 3, "a").select("session_id", "field", "value", "n_clusters", "n_winner")


FEATS = ["agreement", "pair_similarity", "self_consistency", "readers_ok", "format_valid"]


@R.add("mrg_03_merge_features", VOTED + " SELECT session_id, field, " + ", ".join(f"round(({c})::DOUBLE, 6) AS {c}" for c in FEATS) + ", illegible FROM feats WHERE value IS NOT NULL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merged(spark, sf_dir).where("value IS NOT NULL")
    return found.select("session_id", "field", *[F.round(F.element_at("features", F.lit(c)), 6).alias(c) for c in FEATS], "illegible")


@R.add("mrg_04_score_confidence", VOTED + " SELECT session_id, field, p AS confidence FROM scored WHERE value IS NOT NULL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merged(spark, sf_dir).where("value IS NOT NULL")
    return found.select("session_id", "field", M.scored(M.feature_vector(F.col("features"))).alias("confidence"))


@R.add("mrg_05_field_status", VOTED + " SELECT session_id, field, value, status, confidence FROM fields")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("session_id", "field", "value", "status", "confidence")


@R.add(
    "mrg_06_candidates",
    "WITH fx AS (" + READINGS + "), r AS (SELECT *, ord * 10 + sample AS line, CASE WHEN reader <> 'a' AND value IS NOT NULL THEN ord END AS x0, CASE WHEN reason = 'illegible' THEN reader || sample END AS raw FROM fx WHERE status = 'ok') "
    "SELECT session_id, field, coalesce(string_agg(CASE WHEN value IS NOT NULL THEN reader || '#' || sample || '=' || value END, ';' ORDER BY ord, sample), '') AS candidates, coalesce(string_agg(CASE WHEN value IS NOT NULL THEN reader || '#' || sample || '=' || line END, ';' ORDER BY ord, sample), '') AS sources, "
    "arg_min(raw, ord * 10 + sample) FILTER (raw IS NOT NULL) AS raw_partial, arg_min(x0, ord * 10 + sample) FILTER (x0 IS NOT NULL) AS x0 FROM r GROUP BY session_id, field",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("value").isNotNull(), F.array((F.col("ord") * 10 + F.col("sample")).cast("string"))).otherwise(F.array().cast("array<string>"))
    edge = F.when((F.col("reader") != "a") & F.col("value").isNotNull(), F.col("ord"))
    rows = readings(spark, sf_dir).withColumns({"lines": line, **dict.fromkeys(("x0", "y0", "x1", "y1"), edge), "raw_partial": F.when(F.col("reason") == "illegible", F.concat("reader", F.col("sample").cast("string")))})
    shown = lambda c, v: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], v(e["value"]))), ";")
    return M.provenance(rows).select("session_id", "field", shown("candidates", lambda v: v).alias("candidates"), shown("sources", lambda v: F.array_join(v, "+")).alias("sources"), "raw_partial", F.col("box.x0").alias("x0"))


@R.add(
    "mrg_07_medoid_vote",
    MODES + ", pairs AS (SELECT x.session_id, x.field, x.ord, x.value, count(*) AS n FROM best x JOIN best y ON x.session_id = y.session_id AND x.field = y.field AND x.norm IS NOT NULL AND y.norm IS NOT NULL "
    f"AND {sim('x.norm', 'y.norm')} >= 0.9 GROUP BY ALL) SELECT session_id, field, arg_min(value, -n * 10 + ord) AS value, round(max(n) / 3.0, 6) AS agreement FROM pairs GROUP BY session_id, field",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = modes(spark, sf_dir).where("norm IS NOT NULL").groupBy("session_id", "field").agg(F.array_sort(F.collect_list(F.struct("ord", "value", "norm"))).alias("votes"))
    return votes.withColumn("m", M.medoid(F.col("votes"), 3)).select("session_id", "field", "m.value", F.round("m.agreement", 6).alias("agreement"))


@R.add(
    "dec_01_session_confidence",
    VOTED + " SELECT session_id, round(exp(sum(ln(greatest(CASE WHEN value IS NULL THEN 0.0 ELSE confidence END, 1e-9)))), 4) AS confidence FROM fields GROUP BY session_id",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.session_confidence(results(spark, sf_dir))


DECIDED = (
    VOTED
    + ", codes AS (SELECT session_id, CASE status WHEN 'low_confidence' THEN 'LOW_CONF_FIELD' WHEN 'unreadable' THEN 'UNREADABLE_FIELD' WHEN 'not_present' THEN 'MISSING_FIELD' WHEN 'invalid_format' THEN 'INVALID_FORMAT' END AS code, "
    + "min(CASE field WHEN 'priority' THEN 0 WHEN 'placed' THEN 1 ELSE 2 END) AS place FROM fields WHERE status <> 'ok' GROUP BY session_id, status), "
    + "confs AS (SELECT session_id, round(exp(sum(ln(greatest(CASE WHEN value IS NULL THEN 0.0 ELSE confidence END, 1e-9)))), 4) AS confidence FROM fields GROUP BY session_id), "
    + "rows_ AS (SELECT session_id, code, place FROM codes UNION ALL SELECT session_id, 'LOW_SESSION_CONFIDENCE', 99 FROM confs WHERE confidence < 0.8), "
    + "lists AS (SELECT session_id, string_agg(code, ',' ORDER BY place) AS reasons FROM rows_ GROUP BY session_id)"
)


@R.add("dec_02_reason_codes", DECIDED + " SELECT session_id, reasons FROM lists")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.decide(results(spark, sf_dir)).where("size(reasons) > 0").select("session_id", F.array_join("reasons", ",").alias("reasons"))


@R.add("dec_03_decide", DECIDED + " SELECT session_id, CASE WHEN reasons IS NULL THEN 'auto_pass' ELSE 'human_review' END AS outcome, confidence, coalesce(reasons, '') AS reasons FROM confs LEFT JOIN lists USING (session_id)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.decide(results(spark, sf_dir)).select("session_id", "outcome", "confidence", F.array_join("reasons", ",").alias("reasons"))
