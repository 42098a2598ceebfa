"""Queries of the operational jobs over orders, line items, events and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.operators import ops as O
from fieldtrust.plans.base import Registry, for_spark

R = Registry()

SESSIONS = "SELECT o_orderkey AS session_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'awaiting_upload' ELSE 'needs_review' END AS status, o_orderdate AS updated_at, o_orderdate AS created_at, CAST(o_custkey % 10 AS STRING) AS tenant_id, CASE WHEN o_custkey % 7 = 0 THEN 'document' ELSE 'kyc' END AS kind FROM {orders}"
DOCUMENTS = "SELECT l_orderkey AS session_id, l_linenumber AS slot, l_partkey AS part, l_returnflag = 'R' AS superseded, l_linestatus = 'F' AS stored, l_shipdate AS created_at FROM {lineitem}"
HISTORY = "SELECT l_orderkey AS session_id, l_linenumber AS slot, l_partkey AS field, v.version, CASE WHEN v.version = 1 THEN l_returnflag ELSE l_returnflag || '!' END AS value, CASE WHEN v.version = 1 THEN 'model' ELSE 'corrected' END AS source FROM {lineitem} JOIN (VALUES (1), (2)) AS v(version) ON v.version = 1 OR l_discount > 0.05"
REMINDERS = "SELECT o_orderkey AS session_id, 1 AS slot, CAST(o_orderdate AS DATE) AS day, o_orderstatus = 'P' AS unreadable FROM {orders}"
REQUESTS = "SELECT CAST(user_id % 10 AS STRING) AS tenant_id, user_id AS key, ts, event_id AS request_id, event_type AS hash FROM {events}"
AUDIT = "SELECT user_id AS tenant_id, event_id AS id, event_type || ':' || CAST(event_id AS STRING) AS body FROM {events}"


def fx(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return for_spark(spark, sf_dir, sql)


def over(sql: str, rest: str) -> str:
    return "WITH fx AS (" + sql + ") " + rest


@R.add("ops_01_tenant_view", over(SESSIONS, "SELECT session_id, status FROM fx WHERE tenant_id = '3'"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.tenant_view(fx(spark, sf_dir, SESSIONS), "3").select("session_id", "status")


@R.add("ops_02_current_documents", over(DOCUMENTS, "SELECT session_id, slot, part, created_at FROM fx WHERE NOT superseded"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.current_documents(fx(spark, sf_dir, DOCUMENTS)).select("session_id", "slot", "part", "created_at")


@R.add("ops_03_missing_uploads", over(SESSIONS, "SELECT session_id, s.slot FROM fx CROSS JOIN (VALUES (1), (2)) AS s(slot) WHERE status = 'awaiting_upload' AND NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = session_id AND l_linenumber = s.slot)"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = fx(spark, sf_dir, SESSIONS).select("session_id", "status", F.explode(F.array(F.lit(1), F.lit(2))).alias("slot"))
    return O.missing_uploads(slots, fx(spark, sf_dir, DOCUMENTS)).select("session_id", "slot")


@R.add("ops_04_session_view", over(DOCUMENTS, ", h AS (" + HISTORY + "), l AS (SELECT session_id, slot, field, max(version) AS version, arg_max(value, (version, value)) AS value, arg_max(source, (version, value)) AS source FROM h GROUP BY ALL) SELECT fx.session_id, fx.slot, l.field, l.value, CASE WHEN l.version > 1 THEN 'ok' ELSE 'low_confidence' END AS status FROM fx JOIN l ON fx.session_id = l.session_id AND fx.slot = l.slot AND NOT superseded"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = O.latest_version(fx(spark, sf_dir, HISTORY), ["session_id", "slot", "field"]).withColumn("status", F.lit("low_confidence"))
    return O.session_view(fx(spark, sf_dir, DOCUMENTS), latest).select("session_id", "slot", "field", "value", "status")


LATEST = "SELECT o_custkey + 5 AS k, max(o_orderpriority) AS value FROM {orders} GROUP BY o_custkey"


@R.add(
    "ops_05_upsert_fields",
    over(LATEST, ", o AS (SELECT c_custkey AS k, c_mktsegment AS value FROM {customer}) SELECT 'current' AS kind, coalesce(o.k, fx.k) AS k, coalesce(fx.value, o.value) AS value, CASE WHEN fx.k IS NULL THEN 'model' ELSE 'reviewer' END AS source, (o.k IS NOT NULL)::INT + (fx.k IS NOT NULL)::INT AS version FROM o FULL JOIN fx ON o.k = fx.k "
    "UNION ALL SELECT 'history', fx.k, fx.value, 'reviewer', 1 + (o.k IS NOT NULL)::INT FROM fx LEFT JOIN o ON o.k = fx.k"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = fx(spark, sf_dir, "SELECT c_custkey AS k, c_mktsegment AS value, 'model' AS source, 1 AS version FROM {customer}")
    new = fx(spark, sf_dir, LATEST).withColumn("source", F.lit("reviewer"))
    return O.upserted(old, new, ["k"]).withColumn("kind", F.lit("current")).unionByName(O.appended_history(old, new, ["k"]).withColumn("kind", F.lit("history")))


@R.add("ops_06_latest_version", over(HISTORY, "SELECT session_id, slot, field, arg_max(value, (version, value)) AS value, max(version) AS version FROM fx GROUP BY ALL"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.latest_version(fx(spark, sf_dir, HISTORY), ["session_id", "slot", "field"]).drop("source")


ITEMS = "SELECT o_orderkey AS session_id, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS state, o_orderpriority AS reason, o_orderdate AS created_at FROM {orders}"


@R.add("ops_07_review_queue", over(ITEMS, "SELECT session_id, tenant_id, date_diff('second', fx.created_at, TIMESTAMP '2005-01-01') AS age_seconds FROM fx JOIN (" + SESSIONS + ") s USING (session_id) WHERE state = 'open' AND reason = '2-HIGH' ORDER BY fx.created_at, session_id LIMIT 200"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fx(spark, sf_dir, ITEMS).withColumn("reasons", F.array("reason"))
    sessions = fx(spark, sf_dir, SESSIONS).select("session_id", "tenant_id")
    return O.review_queue(items, sessions, F.lit("2005-01-01").cast("timestamp"), "2-HIGH", 1000).select("session_id", "tenant_id", "age_seconds")


@R.add("ops_08_apply_corrections", "SELECT l_orderkey AS session_id, l_linenumber AS slot, 'fixed' AS value, 2 AS version FROM {lineitem} GROUP BY ALL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = fx(spark, sf_dir, "SELECT DISTINCT l_orderkey AS session_id, CAST(l_linenumber AS STRING) AS slot, 'f' AS field, 1 AS version FROM {lineitem}")
    asked = fx(spark, sf_dir, "SELECT o_orderkey AS session_id FROM {orders}").withColumn("values", F.create_map(*[F.lit(x) for k in range(1, 8) for x in (f"{k}.f", "fixed")], F.lit("1.unknown"), F.lit("x")))
    return O.apply_corrections(asked, fields)[0].select("session_id", F.col("slot").cast("int").alias("slot"), "value", "version")


STATUS = "SELECT user_id AS session_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'submitted' WHEN 'view' THEN 'processing' WHEN 'error' THEN 'needs_review' ELSE 'completed' END AS status FROM {events}"


@R.add("ops_10_allowed_transitions", over(STATUS, ", s AS (SELECT *, lag(status) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS before FROM fx) SELECT session_id, event_id, before, status FROM s WHERE before IS NOT NULL AND before <> status AND (before, status) NOT IN (" + ", ".join(str(m) for m in O.MOVES) + ")"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.illegal_moves(fx(spark, sf_dir, STATUS)).select("session_id", "event_id", "before", "status")


@R.add("ops_12_duplicate_identifiers", "SELECT CAST(c_custkey % 3 AS STRING) AS tenant_id, c_nationkey AS nation, count(DISTINCT c_custkey) AS sessions FROM {customer} GROUP BY ALL HAVING count(DISTINCT c_custkey) > 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx(spark, sf_dir, "SELECT c_custkey AS session_id, CAST(c_custkey % 3 AS STRING) AS tenant_id, c_nationkey, 'id' AS field FROM {customer}")
    hashed = rows.withColumn("hash", O.identifier_hash(F.lit("id"), F.col("c_nationkey").cast("string"), "test key"))
    names = hashed.select("hash", F.col("c_nationkey").alias("nation")).distinct()
    return O.duplicate_identifiers(hashed).join(names, "hash").select("tenant_id", "nation", "sessions")


@R.add("ops_13_seal_columns", "SELECT c_custkey, c_name AS opened, NULL::VARCHAR AS elsewhere FROM {customer}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, context = F.lit(b"0123456789abcdef"), F.col("c_custkey").cast("string")
    rows = fx(spark, sf_dir, "SELECT c_custkey, c_name FROM {customer}").withColumn("sealed", O.sealed(F.col("c_name"), key, context))
    return rows.select("c_custkey", O.unsealed(F.col("sealed"), key, context).alias("opened"), O.unsealed(F.col("sealed"), key, F.concat(context, F.lit("x"))).alias("elsewhere"))


@R.add("ops_14_expiry_reminders", over(REMINDERS, "SELECT session_id, slot, day + 365 AS due, day + 335 AS notify_at, 'scheduled' AS status FROM fx WHERE NOT unreadable"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reminders(spark, sf_dir)


def reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx(spark, sf_dir, REMINDERS)
    return O.expiry_reminders(rows.select("session_id", "slot", F.when(~F.col("unreadable"), F.date_add("day", 365)).alias("due")))


@R.add(
    "ops_14_rescheduled_reminders",
    over(REMINDERS, "SELECT session_id, slot, day + 365 AS due, CASE WHEN session_id % 3 = 0 THEN 'sent' ELSE 'scheduled' END AS status FROM fx WHERE NOT unreadable AND (session_id % 3 = 0 OR session_id % 2 = 1) UNION ALL SELECT session_id, slot, day + 400, 'scheduled' FROM fx WHERE NOT unreadable AND session_id % 2 = 0"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = reminders(spark, sf_dir).withColumn("status", F.when(F.col("session_id") % 3 == 0, "sent").otherwise(F.col("status")))
    # every second session was read again and has a later expiry day
    days = fx(spark, sf_dir, REMINDERS).where("session_id % 2 = 0").select("session_id", "slot", F.when(~F.col("unreadable"), F.date_add("day", 400)).alias("due"))
    return O.rescheduled(old, days).select("session_id", "slot", "due", "status")


@R.add("ops_16_cancel_reminders", over(REMINDERS, "SELECT session_id, CASE WHEN session_id % 3 = 0 THEN 'sent' WHEN session_id % 2 = 0 THEN 'cancelled' ELSE 'scheduled' END AS status, false AS refused FROM fx WHERE NOT unreadable UNION ALL SELECT session_id, 'sent', true FROM fx WHERE NOT unreadable AND session_id % 6 = 0"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = reminders(spark, sf_dir).withColumn("status", F.when(F.col("session_id") % 3 == 0, "sent").otherwise(F.col("status")))
    done, refused = O.cancelled(old, old.where("session_id % 2 = 0"))
    return done.select("session_id", "status", F.lit(False).alias("refused")).unionByName(refused.select("session_id", "status", F.lit(True).alias("refused")))


@R.add("ops_15_due_reminders", over(REMINDERS, "SELECT session_id, slot, 'document.expiring' AS event FROM fx WHERE NOT unreadable AND day + 335 <= DATE '1998-06-01'"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.due_reminders(reminders(spark, sf_dir), F.lit("1998-06-01").cast("date"))[1]


@R.add("ops_16_list_reminders", over(REMINDERS, "SELECT session_id, day + 365 AS due FROM fx WHERE NOT unreadable AND day + 365 < DATE '2000-01-01' ORDER BY day, session_id LIMIT 100"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.list_reminders(reminders(spark, sf_dir), "scheduled", F.lit("2000-01-01").cast("date")).select("session_id", "due")


@R.add("ops_17_retention_sweep", over(DOCUMENTS, "SELECT fx.session_id, slot FROM fx JOIN {orders} ON o_orderkey = session_id WHERE stored AND o_custkey % 7 <> 0 AND o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1999-01-31' - INTERVAL 30 DAY"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.retention_sweep(fx(spark, sf_dir, DOCUMENTS), fx(spark, sf_dir, SESSIONS), F.lit("1999-01-31").cast("timestamp"))[0]


HOOKS = "SELECT CAST(n_nationkey % 10 AS STRING) AS tenant_id, n_nationkey AS webhook_id, n_nationkey % 4 <> 0 AS active FROM {nation}"


@R.add("ops_18_fan_out", over(HOOKS, "SELECT event_id, webhook_id, event_type AS event FROM {events} JOIN fx ON tenant_id = CAST(user_id % 10 AS STRING) WHERE active AND event_type IN ('click', CASE WHEN webhook_id % 2 = 0 THEN 'error' ELSE 'view' END)"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    hooks = fx(spark, sf_dir, HOOKS).withColumn("events", F.array(F.lit("click"), F.when(F.col("webhook_id") % 2 == 0, "error").otherwise("view")))
    return O.fan_out(fx(spark, sf_dir, "SELECT event_id, CAST(user_id % 10 AS STRING) AS tenant_id, event_type AS event FROM {events}"), hooks)


DELIVERIES = "SELECT event_id, CAST(event_id % 9 + 1 AS INT) AS attempts, event_id % 5 = 0 AS delivered, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS created_at, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL '22' HOUR AS now FROM {events}"


@R.add("ops_19_retry_schedule", over(DELIVERIES, ", d AS (SELECT *, now + to_seconds([30, 120, 600, 1800, 3600, 7200, 14400][least(attempts, 7)]) AS nxt FROM fx) SELECT event_id, CASE WHEN delivered THEN 'delivered' WHEN nxt > created_at + INTERVAL 24 HOUR THEN 'failed' ELSE 'pending' END AS status, CASE WHEN NOT delivered AND nxt <= created_at + INTERVAL 24 HOUR THEN nxt END AS next_at FROM d"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.retry_schedule(fx(spark, sf_dir, DELIVERIES)).select("event_id", "status", "next_at")


@R.add(
    "ops_20_idempotent",
    "WITH RECURSIVE fx AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, key ORDER BY ts, request_id) AS n FROM (" + REQUESTS + ")), w AS (SELECT tenant_id, key, n, request_id, ts AS since, hash, 'run' AS verdict FROM fx WHERE n = 1 "
    "UNION ALL SELECT fx.tenant_id, fx.key, fx.n, fx.request_id, CASE WHEN fx.ts >= w.since + INTERVAL 24 HOUR THEN fx.ts ELSE w.since END, CASE WHEN fx.ts >= w.since + INTERVAL 24 HOUR THEN fx.hash ELSE w.hash END, "
    "CASE WHEN fx.ts >= w.since + INTERVAL 24 HOUR THEN 'run' WHEN fx.hash = w.hash THEN 'replay' ELSE 'conflict' END FROM w JOIN fx ON fx.tenant_id = w.tenant_id AND fx.key = w.key AND fx.n = w.n + 1) SELECT tenant_id, key, request_id, verdict FROM w",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.idempotent(fx(spark, sf_dir, REQUESTS))


#: Requests are answered after up to 40 minutes, or never; some fail.
ANSWERS = "SELECT CAST(user_id % 3 AS STRING) AS tenant_id, user_id % 20 AS key, ts, event_id AS request_id, event_type AS hash, CASE WHEN event_id % 11 <> 0 THEN ts + INTERVAL '1' MINUTE * (event_id % 40) END AS done_at, event_id % 7 <> 0 AS ok FROM {events}"


@R.add(
    "ops_20_in_progress",
    "WITH RECURSIVE fx AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, key ORDER BY ts, request_id) AS n, least(ts + INTERVAL 24 HOUR, CASE WHEN NOT ok THEN done_at END) AS until FROM (" + ANSWERS + ")), "
    "w AS (SELECT tenant_id, key, n, request_id, until AS ends, hash, done_at AS done, 'run' AS verdict FROM fx WHERE n = 1 "
    "UNION ALL SELECT fx.tenant_id, fx.key, fx.n, fx.request_id, CASE WHEN fx.ts >= w.ends THEN fx.until ELSE w.ends END, CASE WHEN fx.ts >= w.ends THEN fx.hash ELSE w.hash END, CASE WHEN fx.ts >= w.ends THEN fx.done_at ELSE w.done END, "
    "CASE WHEN fx.ts >= w.ends THEN 'run' WHEN fx.hash <> w.hash THEN 'conflict' WHEN w.done <= fx.ts THEN 'replay' ELSE 'in_progress' END FROM w JOIN fx ON fx.tenant_id = w.tenant_id AND fx.key = w.key AND fx.n = w.n + 1) SELECT tenant_id, key, request_id, verdict FROM w",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.idempotent(fx(spark, sf_dir, ANSWERS))


@R.add(
    "ops_21_rate_limit",
    "WITH RECURSIVE fx AS (SELECT user_id % 20 AS key, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS n FROM {events}), "
    "w AS (SELECT key, n, event_id, us, 180000000::BIGINT AS have FROM fx WHERE n = 1 "
    "UNION ALL SELECT fx.key, fx.n, fx.event_id, fx.us, least(180000000, w.have - CASE WHEN w.have >= 60000000 THEN 60000000 ELSE 0 END + (fx.us - w.us) * 3) FROM w JOIN fx ON fx.key = w.key AND fx.n = w.n + 1) "
    "SELECT key, event_id, have >= 60000000 AS allowed, round(greatest(60000000 - have, 0) / 3e6, 6) AS wait_seconds FROM w",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    limited = O.rate_limit(fx(spark, sf_dir, "SELECT user_id % 20 AS key, event_id, ts FROM {events}"), 3)
    return limited.withColumn("wait_seconds", F.round("wait_seconds", 6))


CHAIN = (
    "WITH RECURSIVE fx AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY id) AS n FROM (" + AUDIT + ")), c AS (SELECT tenant_id, id, n, body, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || body) AS hash FROM fx WHERE n = 1 "
    "UNION ALL SELECT fx.tenant_id, fx.id, fx.n, fx.body, c.hash, sha256(c.hash || fx.body) FROM c JOIN fx ON fx.tenant_id = c.tenant_id AND fx.n = c.n + 1)"
)


@R.add("ops_23_append_audit", CHAIN + " SELECT tenant_id, id, prev_hash, hash FROM c")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.append_audit(fx(spark, sf_dir, AUDIT)).drop("body")


@R.add("ops_22_verify_audit_chain", "WITH fx AS (" + AUDIT + ") SELECT tenant_id, min(CASE WHEN id % 97 = 0 THEN id END) IS NULL AS intact, min(CASE WHEN id % 97 = 0 THEN id END) AS first_bad FROM fx GROUP BY tenant_id")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = O.append_audit(fx(spark, sf_dir, AUDIT))
    return O.verify_audit(log.withColumn("body", F.when(F.col("id") % 97 == 0, F.concat("body", F.lit("tampered"))).otherwise(F.col("body"))))


CALLS = "SELECT l_returnflag AS endpoint, l_linestatus AS model, CAST(round(l_extendedprice / 100) AS BIGINT) AS latency, l_discount < 0.08 AS ok FROM {lineitem}"


@R.add("ops_24_call_metrics", over(CALLS, "SELECT endpoint, model, count(*) AS calls, count(CASE WHEN NOT ok THEN 1 END) AS failures, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95 FROM fx GROUP BY GROUPING SETS ((), (endpoint), (model))"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.call_metrics(fx(spark, sf_dir, CALLS), ["endpoint", "model"]).withColumns({"p50": F.round("p50", 6), "p95": F.round("p95", 6)})


@R.add("ops_25_active_keys", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {supplier} WHERE s_suppkey = c_custkey AND s_suppkey % 5 <> 0)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = fx(spark, sf_dir, "SELECT sha2(s_name, 256) AS key_hash, s_suppkey % 5 = 0 AS revoked FROM {supplier}")
    lookups = fx(spark, sf_dir, "SELECT c_custkey, replace(c_name, 'Customer', 'Supplier') AS token FROM {customer}")
    return O.active_keys(lookups, keys).select("c_custkey")


@R.add("ops_26_rejected_sessions", "SELECT o_orderkey AS session_id, CASE WHEN o_orderkey % 12 = 0 OR o_orderkey % 12 > 10 THEN 'count' WHEN o_orderkey % 12 > 4 THEN 'repeated' WHEN o_orderkey % 12 = 4 THEN 'unknown' END AS problem FROM {orders} WHERE o_orderkey % 12 = 0 OR o_orderkey % 12 >= 4")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") % 12).cast("int")
    slots = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("s"), F.when(i > 4, i - 4).otherwise(i).cast("string")))).otherwise(F.array().cast("array<string>"))
    return O.rejected_sessions(fx(spark, sf_dir, "SELECT o_orderkey FROM {orders}").select(F.col("o_orderkey").alias("session_id"), slots.alias("slots")), ["s1", "s2", "s3"])
