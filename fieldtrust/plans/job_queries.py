"""Queries of classification, bake-off, sources, synthetic data and the remaining session jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.operators import bakeoff as B
from fieldtrust.operators import classify as C
from fieldtrust.operators import crossdoc as X
from fieldtrust.operators import merge as M
from fieldtrust.operators import review as V
from fieldtrust.operators import synth as Y
from fieldtrust.plans.base import Registry, for_spark
from fieldtrust.sources import tables as S

R = Registry()

TYPES = [("en", "id1_card", "the", ["and", "of", "with", "from", "that"]), ("fr", "id1_card", "les", ["des", "que", "une", "avec", "pour"]), ("de", "a4", "und", ["der", "mit", "das", "von", "sich"]), ("es", "a4", "los", ["las", "por", "con", "para", "ción"])]
SHAPED = "SELECT doc_id, lower(text) AS norm_text, source AS slot, CASE doc_id % 3 WHEN 0 THEN 1.586E0 WHEN 1 THEN 1.414E0 END AS aspect FROM {documents}"


def fx(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return for_spark(spark, sf_dir, sql)


def over(sql: str, rest: str) -> str:
    return "WITH fx AS (" + sql + ") " + rest


def types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TYPES, "type string, shape string, title string, labels array<string>")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.label_scores(fx(spark, sf_dir, SHAPED), types(spark))


SCORED = "t AS (" + " UNION ALL ".join("SELECT doc_id, slot, aspect, '{}' AS type, '{}' AS shape, ({} + 2 * contains(norm_text, '{}')::INT) / 7.0E0 AS score FROM fx".format(t, s, " + ".join(f"contains(norm_text, '{x}')::INT" for x in labels), title) for t, s, title, labels in TYPES) + ")"
CLASSES = (
    "f AS (SELECT *, CASE WHEN abs(aspect - 1.5857725E0) <= 0.08 * 1.5857725E0 THEN 'id1_card' WHEN abs(aspect - 1.4142857E0) <= 0.08 * 1.4142857E0 THEN 'a4' END AS sh FROM t), "
    "k AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS nx FROM (SELECT * FROM f WHERE sh IS NULL OR sh = shape) WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, type)), "
    "c AS (SELECT doc_id, slot, CASE WHEN score > 0 THEN type ELSE 'other' END AS type, CASE WHEN score > 0 THEN round(least(1.0, 0.5 + score - coalesce(nx, 0)), 3) ELSE 0.0 END::DOUBLE AS confidence FROM k WHERE k = 1)"
)


@R.add("ext_06_label_scores", over(SHAPED, ", " + SCORED + " SELECT doc_id, type, round(score, 6) AS score FROM t"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("doc_id", "type", F.round("score", 6).alias("score"))


@R.add("ext_07_classify", over(SHAPED, ", " + SCORED + ", " + CLASSES + " SELECT doc_id, type, confidence FROM c"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classified(scores(spark, sf_dir), ["doc_id", "slot"]).select("doc_id", "type", "confidence")


@R.add("ext_09_wrong_slot_check", over(SHAPED, ", " + SCORED + ", " + CLASSES + " SELECT doc_id, type, 'wrong_document_in_slot' AS code FROM c WHERE type <> 'other' AND confidence >= 0.7"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.wrong_slots(C.classified(scores(spark, sf_dir), ["doc_id", "slot"])).select("doc_id", "type", "code")


@R.add("ext_13_quality_bucket", "SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 4 = 3 OR p_size % 20 >= 13 THEN 'worst' WHEN p_partkey % 4 IN (1, 2) OR p_size % 20 > 0 OR p_partkey % 50 >= 30 THEN 'medium' ELSE 'good' END AS bucket FROM {part}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: c.cast("string")
    key = F.col("p_partkey")
    light = F.element_at(F.array(*map(F.lit, ["normal", "dim", "shadow", "backlit"])), (key % 4 + 1).cast("int"))
    condition = F.create_map(F.lit("glare"), text(key % 11 == 0), F.lit("light"), light, F.lit("motion_blur"), text(F.col("p_size") % 20), F.lit("angle"), text(key % 50), F.lit("jpeg_quality"), F.lit("90"))
    return fx(spark, sf_dir, "SELECT p_partkey, p_size FROM {part}").select(key.alias("id"), C.quality_bucket(condition).alias("bucket"))


MARKS = "SELECT o_orderkey AS session_id, s.slot, s.field, 'ok' AS status, CAST(NULL AS STRING) AS reason FROM {orders} CROSS JOIN (VALUES ('card', 'name'), ('licence', 'owner'), ('licence', 'other')) AS s(slot, field)"


@R.add("xdc_04_mark_mismatches", over(MARKS, "SELECT session_id, slot, field, CASE WHEN session_id % 4 = 0 AND field <> 'other' THEN 'mismatch' ELSE status END AS status, CASE WHEN session_id % 4 = 0 AND field <> 'other' THEN 'same_name' END AS reason FROM fx"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = spark.createDataFrame([("card", "name"), ("licence", "owner"), ("licence", "other")], "slot string, field string")
    rules = X.resolved(spark, [X.PairRule("same_name", "card.name", "licence.owner", "exact")], specs)
    failed = fx(spark, sf_dir, "SELECT o_orderkey AS session_id, 'same_name' AS rule, CASE WHEN o_orderkey % 4 = 0 THEN 'mismatch' ELSE 'partial_match' END AS status FROM {orders}")
    return X.mark_mismatches(fx(spark, sf_dir, MARKS), failed, rules)


BAKE = "SELECT o_orderkey AS capture, r.reader, 0 AS sample, p.pos, CASE p.pos WHEN 1 THEN 'Name: ' || CASE WHEN r.reader = 'b' AND o_orderkey % 3 = 0 THEN substring(o_orderpriority, 2) ELSE o_orderpriority END ELSE 'Key: ' || CASE WHEN r.reader = 'a' AND o_orderkey % 5 = 0 THEN '9' ELSE '' END || o_orderkey END AS text FROM {orders} CROSS JOIN (VALUES ('a'), ('b')) AS r(reader) CROSS JOIN (VALUES (1), (2)) AS p(pos)"
TRUE_FIELDS = "SELECT o_orderkey AS capture, f.field, f.grp, f.label AS norm_label, CASE WHEN f.field = 'name' THEN o_orderpriority ELSE CAST(o_orderkey AS STRING) END AS truth FROM {orders} CROSS JOIN (VALUES ('name', 'names', 'name'), ('key', 'digits', 'key')) AS f(field, grp, label)"
LEV = "levenshtein(lower(truth), lower(value)) * 1.0E0 / length(truth)"
BEST = (
    "WITH l AS (" + BAKE + "), t AS (" + TRUE_FIELDS + "), p AS (SELECT reader, l.capture, field, grp, pos, truth, CASE WHEN lower(split_part(text, ':', 1)) = norm_label THEN trim(substring(text, instr(text, ':') + 1)) ELSE trim(text) END AS value FROM l JOIN t ON l.capture = t.capture), "
    "b AS (SELECT *, " + LEV + " AS cer, row_number() OVER (PARTITION BY reader, capture, field ORDER BY " + LEV + ", pos) AS k FROM p), best AS (SELECT * FROM b WHERE k = 1), "
    "sc AS (SELECT reader, avg(CASE WHEN grp = 'names' THEN least(cer, 1) END) AS name_cer, avg(CASE WHEN grp = 'digits' THEN (lower(value) = lower(truth))::INT END) AS digit_exact FROM best GROUP BY reader)"
)


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.best_line_values(fx(spark, sf_dir, BAKE), fx(spark, sf_dir, TRUE_FIELDS))


@R.add("evl_10_best_line_value", BEST + " SELECT reader, capture, field, value, round(cer, 6) AS cer FROM best")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(spark, sf_dir).select("reader", "capture", "field", "value", F.round("cer", 6).alias("cer"))


SHOWN = "SELECT o_orderkey AS capture, CASE WHEN o_custkey % 3 = 0 THEN 'arabic_indic' ELSE 'western' END AS digits, CASE o_custkey % 4 WHEN 0 THEN 'worst' WHEN 1 THEN 'medium' WHEN 2 THEN 'good' END AS bucket FROM {orders}"
RUNS = "SELECT o_orderkey AS capture, r.reader, r.sample, CASE WHEN r.reader = 'a' AND r.sample = 0 AND o_custkey % 7 = 0 THEN 'failed' ELSE 'ok' END AS status FROM {orders} CROSS JOIN (VALUES ('a', 0), ('a', 1), ('b', 0)) AS r(reader, sample)"


@R.add(
    "evl_11_bakeoff_scores",
    BEST + ", s AS (" + SHOWN + "), x AS (SELECT best.*, digits, coalesce(bucket, 'good') AS bucket FROM best JOIN s ON s.capture = best.capture), ok AS (SELECT reader, count(DISTINCT capture) AS n_images, count(DISTINCT CASE WHEN sample = 0 AND status <> 'ok' THEN capture END) AS failed_images FROM (" + RUNS + ") GROUP BY reader) "
    "SELECT x.reader, 'all' AS bucket, round(avg(CASE WHEN grp = 'names' THEN least(cer, 1) END), 6) AS name_cer, round(avg(CASE WHEN grp = 'digits' AND digits = 'western' THEN (lower(value) = lower(truth))::INT END), 6) AS digit_exact, round(avg(CASE WHEN grp = 'digits' AND digits <> 'western' THEN (lower(value) = lower(truth))::INT END), 6) AS arabic_indic_digit_exact, any_value(n_images) AS n_images, any_value(failed_images) AS failed_images FROM x JOIN ok ON ok.reader = x.reader GROUP BY x.reader "
    "UNION ALL SELECT reader, bucket, round(avg(least(cer, 1)), 6), NULL, NULL, NULL, NULL FROM x WHERE grp = 'names' GROUP BY reader, bucket",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = best(spark, sf_dir).join(fx(spark, sf_dir, SHOWN), "capture")
    counts = B.image_counts(fx(spark, sf_dir, RUNS))
    whole = B.reader_scores(read).drop("date_exact").join(counts, "reader").withColumn("bucket", F.lit("all"))
    rows = whole.unionByName(B.bucket_scores(read), allowMissingColumns=True)
    return rows.withColumns({c: F.round(c, 6) for c in ("name_cer", "digit_exact", "arabic_indic_digit_exact")})


@R.add("evl_12_pick_primary", BEST + " SELECT grp, CASE WHEN (SELECT name_cer FROM sc WHERE reader = 'b') - (SELECT name_cer FROM sc WHERE reader = 'a') <= 0.05 OR grp IN ('digits', 'dates', 'enums') THEN 'b' ELSE 'a' END AS primary_reader FROM (VALUES ('names'), ('digits'), ('dates'), ('enums'), ('text')) AS g(grp)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.pick_primary(B.reader_scores(best(spark, sf_dir)), "b").withColumnRenamed("primary", "primary_reader")


CAPTURES = "SELECT o_custkey AS session_id, o_orderpriority AS slot, 'x' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '_c' || CAST(o_orderkey % 3 AS STRING) END AS capture FROM {orders}"


@R.add("evl_16_session_attempts", over(CAPTURES, "SELECT session_id, CASE WHEN capture LIKE '%\\_c%' ESCAPE '\\' THEN right(capture, 2) ELSE 'clean' END AS attempt, string_agg(slot, ',' ORDER BY slot) AS slots FROM fx GROUP BY ALL"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.session_attempts(fx(spark, sf_dir, CAPTURES)).withColumn("slots", F.array_join("slots", ","))


KNOTS = "SELECT doc_id AS id, (n_chars % 1000) / 1000.0E0 AS p FROM {documents}"


@R.add("cal_04_interp", over(KNOTS, "SELECT id, round(CASE WHEN p < 0.2 THEN 0.1 WHEN p < 0.4 THEN 0.1 + (p - 0.2) / 0.2 * 0.2 WHEN p < 0.6 THEN 0.3 + (p - 0.4) / 0.2 * 0.5 WHEN p < 0.9 THEN 0.8 + (p - 0.6) / 0.3 * 0.15 ELSE 0.95 END, 6)::DOUBLE AS v FROM fx"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    knots = [F.array(*map(F.lit, x)) for x in ([0.2, 0.4, 0.6, 0.9], [0.1, 0.3, 0.8, 0.95])]
    return fx(spark, sf_dir, KNOTS).select("id", F.round(M.interpolated(F.col("p"), *knots), 6).alias("v"))


@R.add("cal_01_feature_vector", "SELECT o_orderkey AS id, round(CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0.0 END + 0.5 + CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.5 END + 0.5, 6)::DOUBLE AS total FROM {orders}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    given = F.map_filter(F.create_map(F.lit("agreement"), F.when(key % 2 == 0, 0.5), F.lit("format_valid"), F.when(key % 3 == 0, 1.0)), lambda k, v: v.isNotNull())
    total = F.aggregate(M.feature_vector(given), F.lit(0.0), lambda s, x: s + x)
    return fx(spark, sf_dir, "SELECT o_orderkey FROM {orders}").select(key.alias("id"), F.round(total, 6).alias("total"))


@R.add("src_03_load_split", "SELECT o_orderkey FROM {orders} WHERE o_orderkey % 5 = 4")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx(spark, sf_dir, "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN 'tune' WHEN o_orderkey % 5 = 3 THEN 'calibration' ELSE 'test' END AS split FROM {orders}")
    return S.load_split(rows, "test").select("o_orderkey")


@R.add("src_07_pending_images", "WITH t AS (SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS done FROM {lineitem} GROUP BY l_orderkey) SELECT 'a' AS reader, o_orderkey AS sha256 FROM {orders} WHERE NOT EXISTS (SELECT 1 FROM t WHERE l_orderkey = o_orderkey AND done)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = fx(spark, sf_dir, "SELECT 'a' AS reader, o_orderkey AS sha256 FROM {orders}")
    return S.pending_images(images, fx(spark, sf_dir, "SELECT 'a' AS reader, l_orderkey AS sha256, CASE WHEN l_returnflag = 'R' THEN 'unavailable' ELSE 'ok' END AS status FROM {lineitem}"))


BRANDS = "SELECT 'brand' AS field, p_brand AS value FROM {part}"
FIXTURES = over(BRANDS, ", v AS (SELECT DISTINCT field, value FROM fx), m AS (SELECT DISTINCT field, unnest([left(value, length(value) - 1), value || '7', 'X' || substring(value, 2), '', ' ', left(value, length(value) // 2)]) AS value FROM v), f AS (SELECT field, value, 'valid' AS label FROM v UNION ALL SELECT field, value, 'invalid' FROM m WHERE value NOT IN (SELECT value FROM v))")


@R.add("syn_07_rule_fixtures", FIXTURES + " SELECT field, value, label FROM f")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.rule_fixtures(fx(spark, sf_dir, BRANDS))


RULE_ROWS = [("one", "brand", "^Brand#[0-9]$", True, 0), ("two", "brand", "^Brand#[0-9][0-9]?$", True, 0), ("any", "brand", ".*", False, 2)]


@R.add("syn_08_score_rules", FIXTURES + ", r AS (SELECT * FROM (VALUES ('one', '^Brand#[0-9]$', 1.0E0, 0), ('two', '^Brand#[0-9][0-9]?$', 1.0E0, 0), ('any', '.*', 0.5E0, 2)) AS r(rule, pattern, own, errors)) SELECT rule, field, round(avg((regexp_matches(value, pattern) = (label = 'valid'))::INT) * (0.9E0 + 0.1E0 * own) - 0.01E0 * errors, 4) AS score FROM f CROSS JOIN r GROUP BY rule, field, own, errors")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULE_ROWS, "rule string, field string, pattern string, own boolean, errors int")
    return Y.score_rules(rules, Y.rule_fixtures(fx(spark, sf_dir, BRANDS)))


PRINTED = "SELECT o_orderkey AS session_id, 'Order' AS title, f.n AS field_order, f.label, CASE f.n WHEN 0 THEN o_orderpriority WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END ELSE CAST(o_custkey AS STRING) END AS value FROM {orders} CROSS JOIN (VALUES (0, 'Priority'), (1, 'Status'), (2, 'Customer')) AS f(n, label)"


@R.add("syn_06_printed_lines", over(PRINTED, "SELECT session_id, 'Order|' || string_agg(label || ': ' || value, '|' ORDER BY field_order) || '|SPECIMEN' AS lines FROM fx WHERE value IS NOT NULL GROUP BY session_id"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.printed_lines(fx(spark, sf_dir, PRINTED), ["session_id"]).select("session_id", F.array_join("lines", "|").alias("lines"))


STATES = "SELECT o_orderkey AS session_id, 'order' AS slot, f.n AS field_order, f.field, f.field AS label, o_orderkey % 2 = 0 OR f.n = 0 AS required, CASE (o_orderkey + f.n) % 4 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'not_present' ELSE 'ok' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'glare' END AS obstruction, (o_orderkey % 7) / 100.0E0 AS x0 FROM {orders} CROSS JOIN (VALUES (0, 'name'), (1, 'day'), (2, 'number')) AS f(n, field)"


@R.add(
    "dec_06_fallback_brief",
    over(STATES, ", r AS (SELECT session_id, field_order AS n, label || ' on order: ' || status || ' (' || status || ').' AS line FROM fx WHERE status <> 'ok' AND (required OR status <> 'not_present') UNION ALL SELECT o_orderkey, 1000, 'order: photo issues (blur, glare); consider requesting a retake.' FROM {orders} WHERE o_orderkey % 8 = 0 "
    "UNION ALL SELECT o_orderkey, 2000, 'session: late' FROM {orders} WHERE o_orderkey % 23 = 0) SELECT session_id, string_agg(line, '|' ORDER BY n) AS lines FROM r GROUP BY session_id"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = fx(spark, sf_dir, STATES).withColumns({"slot_order": F.lit(0), "reason": F.lit(None).cast("string")})
    quality = fx(spark, sf_dir, "SELECT o_orderkey AS session_id, 0 AS slot_order, 'order' AS slot FROM {orders} WHERE o_orderkey % 8 = 0").withColumn("issues", F.array(F.lit("blur"), F.lit("glare")))
    cross = fx(spark, sf_dir, "SELECT o_orderkey AS session_id, 0 AS n, 'r' AS rule, 'match' AS status, '' AS detail FROM {orders}")
    checks = fx(spark, sf_dir, "SELECT o_orderkey AS session_id, 0 AS n, CAST(NULL AS STRING) AS slot, 'late' AS message, 'warn' AS severity, CAST(NULL AS STRING) AS field FROM {orders} WHERE o_orderkey % 23 = 0")
    return V.fallback_brief(fields, quality, cross, checks).withColumn("lines", F.array_join("lines", "|"))


@R.add(
    "dec_07_retake_requests",
    over(STATES, "SELECT session_id, field, CASE WHEN x0 <= 0.005 THEN 'cut_off' WHEN obstruction = 'glare' THEN 'glare' ELSE 'unreadable' END AS code, CASE WHEN x0 <= 0.005 THEN 'Part of ' || label || ' is outside the picture. Please take a new photo from farther away.' WHEN obstruction = 'glare' THEN 'Light reflects on ' || label || '. Please take a new photo at another angle.' ELSE 'We could not read ' || label || '. Please take a new photo.' END AS text FROM fx WHERE required AND status = 'unreadable'"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = fx(spark, sf_dir, STATES).withColumns({"y0": F.lit(0.3), "x1": F.lit(0.5), "y1": F.lit(0.6)})
    return V.retake_requests(boxes).select("session_id", "field", "code", "text")


BULLETS = "SELECT o_orderkey AS session_id, b.pos, CASE b.pos WHEN 0 THEN 'Status is {{field:order.status}}' WHEN 1 THEN 'Key ends in 7' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Look at {{field:order.unknown}}' ELSE 'Ask for {{field:order.priority}}' END END AS text FROM {orders} CROSS JOIN (VALUES (0), (1), (2)) AS b(pos)"


@R.add("dec_05_render_brief", "SELECT o_orderkey AS session_id, 'Status is ' || o_orderstatus || CASE WHEN o_orderkey % 2 = 1 THEN '|Ask for ' || CASE WHEN o_orderkey % 3 = 0 THEN '[unreadable]' ELSE o_orderpriority END ELSE '' END AS lines FROM {orders}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = fx(spark, sf_dir, "SELECT o_orderkey AS session_id, 'order.status' AS ref, o_orderstatus AS value FROM {orders} UNION ALL SELECT o_orderkey, 'order.priority', CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END FROM {orders}")
    return V.rendered_brief(fx(spark, sf_dir, BULLETS), values).withColumn("lines", F.array_join("lines", "|"))


REVIEWS = "SELECT o_orderkey AS session_id, o_orderstatus = 'O' AS open, CASE o_orderkey % 4 WHEN 1 THEN 'approve' WHEN 2 THEN 'reject' WHEN 3 THEN 'request_retake' END AS action, o_orderkey % 8 = 7 AS wrong, o_orderkey % 3 = 0 AS sent FROM {orders}"


@R.add(
    "ops_09_apply_review_actions",
    over(
        REVIEWS,
        ", a AS (SELECT *, CASE WHEN open AND action IS NOT NULL AND NOT (action = 'request_retake' AND wrong) THEN action END AS done FROM fx) "
        "SELECT 'item' AS kind, session_id, '' AS slot, CASE WHEN done IS NOT NULL OR NOT open THEN 'closed' ELSE 'open' END AS status, NULL::VARCHAR AS outcome FROM a "
        "UNION ALL SELECT 'session', session_id, '', CASE done WHEN 'request_retake' THEN 'retake_requested' WHEN 'approve' THEN 'completed' WHEN 'reject' THEN 'completed' ELSE CASE WHEN open THEN 'needs_review' ELSE 'completed' END END, CASE WHEN done <> 'request_retake' THEN done END FROM a "
        "UNION ALL SELECT 'document', session_id, s.slot, CASE WHEN done = 'request_retake' AND s.slot = 'front' THEN 'superseded' ELSE 'ingested' END, NULL FROM a CROSS JOIN (VALUES ('front'), ('back')) AS s(slot) "
        "UNION ALL SELECT 'document', session_id, 'front', 'awaiting_upload', NULL FROM a WHERE done = 'request_retake' "
        "UNION ALL SELECT 'reminder', session_id, 'front', CASE WHEN sent THEN 'sent' WHEN done = 'reject' THEN 'cancelled' ELSE 'scheduled' END, NULL FROM a "
        "UNION ALL SELECT 'event', session_id, '', CASE WHEN done = 'request_retake' THEN 'session.retake_requested' ELSE 'session.completed' END, CASE WHEN done <> 'request_retake' THEN done END FROM a WHERE done IS NOT NULL "
        "UNION ALL SELECT 'refused', session_id, '', CASE WHEN open THEN 'invalid' ELSE 'conflict' END, NULL FROM a WHERE action IS NOT NULL AND done IS NULL",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx(spark, sf_dir, REVIEWS)
    slots = F.array(F.lit("front"), F.lit("back"))
    sessions = rows.select("session_id", F.when(F.col("open"), "needs_review").otherwise("completed").alias("status"), slots.alias("slots"))
    actions = rows.where("action IS NOT NULL").select("session_id", "action", F.when(F.col("action") == "request_retake", F.array(F.when(F.col("wrong"), "side").otherwise("front"))).alias("retake_slots"))
    documents = rows.select("session_id", F.explode(slots).alias("slot"), F.lit("ingested").alias("status"))
    reminders = rows.select("session_id", F.lit("front").alias("slot"), F.when(F.col("sent"), "sent").otherwise("scheduled").alias("status"))
    done = V.apply_review_actions(rows.select("session_id", F.when(F.col("open"), "open").otherwise("closed").alias("status")), actions, sessions, documents, reminders)
    none = F.lit(None).cast("string").alias("outcome")
    parts = [
        done.items.select(F.lit("item").alias("kind"), "session_id", F.lit("").alias("slot"), "status", none),
        done.sessions.select(F.lit("session").alias("kind"), "session_id", F.lit("").alias("slot"), "status", F.col("final_outcome").alias("outcome")),
        done.documents.select(F.lit("document").alias("kind"), "session_id", "slot", "status", none),
        done.reminders.select(F.lit("reminder").alias("kind"), "session_id", "slot", "status", none),
        done.events.select(F.lit("event").alias("kind"), "session_id", F.lit("").alias("slot"), F.col("event").alias("status"), F.col("final_outcome").alias("outcome")),
        done.refused.select(F.lit("refused").alias("kind"), "session_id", F.lit("").alias("slot"), F.col("reason").alias("status"), none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


IDENTIFIERS = "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'names' ELSE 'digits' END AS grp, CAST(c_custkey * 7919 AS STRING) AS value FROM {customer}"
#: The key of the test hash, padded to a block and combined with the two constants of HMAC, in hex.
INNER, OUTER = (bytes(b ^ x for b in b"test key".ljust(64, b"\0")).hex() for x in (0x36, 0x5C))


@R.add("ops_11_identifier_hash", over(IDENTIFIERS, f"SELECT id, CASE WHEN grp = 'digits' THEN sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode('id_number:' || value)))) END AS hash FROM fx"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldtrust.functions.text import ARABIC_DIGITS
    from fieldtrust.operators.ops import lookup_hash

    rows = fx(spark, sf_dir, IDENTIFIERS)
    # the hash does not see the script or the spaces
    written = F.when(F.col("id") % 3 == 0, F.translate("value", "0123456789", ARABIC_DIGITS[:10])).when(F.col("id") % 3 == 1, F.concat(F.lit(" "), F.substring("value", 1, 2), F.lit(" "), F.col("value").substr(3, 30))).otherwise(F.col("value"))
    return rows.select("id", lookup_hash(F.col("grp"), F.lit("id_number"), written, "test key").alias("hash"))
