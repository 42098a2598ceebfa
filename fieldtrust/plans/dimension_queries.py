"""Queries of the document types' dimensions and rules, of model replies against them, and of made-up sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.functions import dates
from fieldtrust.functions.dates import hijri_months
from fieldtrust.functions.text import ARABIC_DIGITS, normalized, parsed_reply, reply_value
from fieldtrust.operators import extract as X
from fieldtrust.operators import synth as Y
from fieldtrust.operators import validate as V
from fieldtrust.plans.base import Registry, for_spark
from fieldtrust.scratch import scratch_path
from fieldtrust.sources import rulesets as L
from fieldtrust.sources import tables as S

R = Registry()

SLOTS = "CASE o_orderkey % 4 WHEN 0 THEN 'national_id_front' WHEN 1 THEN 'national_id_back' WHEN 2 THEN 'commercial_registration' ELSE 'tax_card' END"


@R.add(
    "src_05_field_specs",
    f"SELECT o_orderkey AS session_id, {SLOTS} AS slot, CASE WHEN o_orderkey % 4 = 2 THEN 'a4' ELSE 'id1_card' END AS shape, CASE o_orderkey % 4 WHEN 0 THEN 'full_name_ar,mother_name_ar,sex,id_number' WHEN 1 THEN 'date_of_birth,place_of_birth_ar,issue_date,expiry_date' "
    "WHEN 2 THEN 'owner_name_ar,business_name_ar,registration_number,governorate_ar,issue_date,expiry_date' ELSE 'holder_name_ar,business_name_ar,tax_number,issue_date,expiry_date' END AS required, [6, 6, 8, 5][o_orderkey % 4 + 1] AS n_fields FROM {orders}",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = L.field_specs(spark).groupBy("slot").agg(F.array_sort(F.collect_list(F.when(F.col("required"), F.struct("field_order", "field")))).alias("fields"), F.count("*").cast("int").alias("n_fields"))
    named = specs.join(L.doc_types(spark), "slot").select("slot", "shape", F.array_join("fields.field", ",").alias("required"), "n_fields")
    return for_spark(spark, sf_dir, f"SELECT o_orderkey AS session_id, {SLOTS} AS slot FROM {{orders}}").join(F.broadcast(named), "slot")


NUMBERS = (
    "SELECT o_orderkey AS id, f.slot, f.field, CASE f.field WHEN 'id_number' THEN lpad(CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN 11 ELSE 12 END, '0') WHEN 'tax_number' THEN concat(CASE WHEN o_orderkey % 5 = 0 THEN 'A' ELSE '7' END, lpad(CAST(o_orderkey AS STRING), 8, '0')) "
    "WHEN 'registration_number' THEN concat(lpad(CAST(o_custkey % 18 AS STRING), 2, '0'), CASE WHEN o_orderkey % 4 = 0 THEN '-' ELSE '/' END, lpad(CAST(o_orderkey % 100000 AS STRING), 5, '0')) ELSE CASE o_orderkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'f' ELSE 'none' END END AS value "
    "FROM {orders} CROSS JOIN (VALUES ('national_id_front', 'id_number'), ('tax_card', 'tax_number'), ('commercial_registration', 'registration_number'), ('national_id_front', 'sex')) AS f(slot, field)"
)


@R.add("src_06_ruleset", "WITH fx AS (" + NUMBERS + ") SELECT id, field, CASE field WHEN 'id_number' THEN id % 3 <> 0 WHEN 'tax_number' THEN id % 5 <> 0 WHEN 'registration_number' THEN id % 4 <> 0 ELSE id % 3 <> 2 END AS valid FROM fx")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = L.load_ruleset(spark)
    values = for_spark(spark, sf_dir, NUMBERS).join(F.broadcast(rules.formats), ["slot", "field"], "left")
    checked = V.enum_valid(values.withColumn("norm", F.when(F.col("field") == "sex", normalized(F.col("value")))), rules.enums)
    return checked.select("id", "field", F.coalesce("in_enum", V.format_valid(F.col("value"), F.lit("digits"), F.col("pattern"), F.lit(None))).alias("valid"))


REPLIES = (
    "SELECT o_orderkey AS session_id, 'order' AS slot, concat('Sure: ', CASE WHEN o_orderkey % 2 = 0 THEN '{{\"fields\": ' ELSE '' END, '{{\"status\": {{\"value\": \"', o_orderstatus, '\", \"spans\": [{{\"line_id\": \"L1\", \"start\": 0, \"end\": 1}}', "
    "CASE WHEN o_orderkey % 3 = 0 THEN ', {{\"line_id\": \"L2\", \"start\": 0}}' ELSE '' END, '], \"line_ids\": [\"L7\"]}}, \"customer\": {{\"value\": ', CAST(o_custkey AS STRING), ', \"line_ids\": [\"L2\", \"L3\"]}}, \"clerk\": \"no object\", \"invented\": {{\"value\": \"x\"}}, "
    "\"priority\": {{\"value\": null, \"reason\": \"illegible\"}}}}', CASE WHEN o_orderkey % 2 = 0 THEN '}}' ELSE '' END) AS reply FROM {orders}"
)


@R.add(
    "ext_03_model_fields",
    "SELECT o_orderkey AS session_id, f.field, CASE f.field WHEN 'status' THEN o_orderstatus WHEN 'customer' THEN CAST(o_custkey AS VARCHAR) END AS value, CASE f.field WHEN 'status' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'L7:0-0' ELSE 'L1:0-1' END WHEN 'customer' THEN 'L2:0-0,L3:0-0' ELSE '' END AS spans, "
    "CASE f.field WHEN 'clerk' THEN 'not_present' WHEN 'missing' THEN 'not_present' WHEN 'priority' THEN 'illegible' END AS reason FROM {orders} CROSS JOIN (VALUES ('status'), ('customer'), ('clerk'), ('priority'), ('missing')) AS f(field)",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = spark.createDataFrame([("order", f) for f in ("status", "customer", "clerk", "priority", "missing")], "slot string, field string")
    found = X.model_fields(for_spark(spark, sf_dir, REPLIES), specs, ["session_id", "slot"])
    text = F.transform("spans", lambda s: F.concat(s["line_id"], F.lit(":"), s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return found.select("session_id", "field", "value", F.array_join(text, ",").alias("spans"), "reason")


PAGE = "SELECT o_orderkey AS session_id, l.pos, concat('L', CAST(l.pos AS STRING)) AS line_id, CASE l.pos WHEN 1 THEN o_orderpriority WHEN 2 THEN concat('No  ', CAST(o_orderkey AS STRING)) ELSE 'the end' END AS text, l.pos * 10.0E0 AS y0, CASE WHEN l.pos < 3 THEN 0.5E0 * l.pos END AS conf FROM {orders} CROSS JOIN (VALUES (1), (2), (3)) AS l(pos)"
CLAIMED = "SELECT o_orderkey AS session_id, 'f' AS field, CASE o_orderkey % 6 WHEN 0 THEN o_orderpriority WHEN 1 THEN concat(o_orderpriority, ' No') WHEN 2 THEN concat(o_orderpriority, ' No') WHEN 3 THEN 'end' WHEN 4 THEN concat('No ', CAST(o_orderkey AS STRING)) END AS value, o_orderpriority AS given FROM {orders}"


@R.add(
    "ext_04_verify_spans",
    "SELECT o_orderkey AS session_id, CASE o_orderkey % 6 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderpriority || ' No' WHEN 2 THEN o_orderpriority || ' No' WHEN 4 THEN 'No  ' || o_orderkey END AS value, CASE o_orderkey % 6 WHEN 3 THEN 'not_verbatim' WHEN 5 THEN 'not_present' END AS reason, "
    "CASE o_orderkey % 6 WHEN 0 THEN '1' WHEN 1 THEN '1,2' WHEN 2 THEN '1,2' WHEN 4 THEN '2' END AS lines, CASE o_orderkey % 6 WHEN 4 THEN 20.0E0 WHEN 3 THEN NULL WHEN 5 THEN NULL ELSE 10.0E0 END AS y0, CASE o_orderkey % 6 WHEN 0 THEN 0.5E0 WHEN 1 THEN 0.75E0 WHEN 2 THEN 0.75E0 WHEN 4 THEN 1.0E0 END AS line_conf FROM {orders}",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = lambda line, start, end: F.struct(F.lit(line).alias("line_id"), F.lit(start).alias("start"), (end if isinstance(end, F.Column) else F.lit(end)).cast("int").alias("end"))
    case, whole = F.col("session_id") % 6, span("L1", 0, F.char_length("given"))
    spans = F.when(case == 0, F.array(whole)).when(case == 1, F.array(whole, span("L2", 0, 2))).when(case == 2, F.array(span("L1", 0, 0), span("L2", 0, 0))).when(case == 3, F.array(span("L1", 0, 0))).otherwise(F.array(span("L9", 0, 3)))
    claims = for_spark(spark, sf_dir, CLAIMED).withColumn("spans", spans).select("session_id", "field", "value", "spans", F.lit(None).cast("string").alias("reason"))
    lines = for_spark(spark, sf_dir, PAGE)
    boxes = lines.select("session_id", "pos", F.lit(0.0).alias("x0"), "y0", F.lit(9.0).alias("x1"), (F.col("y0") + 5).alias("y1"), "conf")
    found = X.with_line_evidence(X.verified_spans(claims, lines, ["session_id"]), boxes, ["session_id"])
    return found.select("session_id", "value", "reason", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"), "y0", "line_conf")


VARIED = "CASE c_custkey % 10 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(Y.VARIANTS)) + " ELSE 'clean' END"


@R.add(
    "syn_02_sessions",
    "WITH v AS (SELECT c_custkey, " + VARIED + " AS v FROM {customer}) SELECT c_custkey AS session_id, v IN ('license_missing_grandfather', 'swapped_business_name', 'expired_license', 'different_person', 'underage') AS human_expected, 25 AS n_values, v <> 'license_missing_grandfather' AS same_owner, v <> 'different_person' AS same_holder, "
    "v <> 'swapped_business_name' AS same_business, v = 'expired_license' AS expired, v = 'underage' AS underage, v = 'hijri_dates' AS hijri, v = 'arabic_indic_digits' AS arabic_digits, true AS numbers_valid, true AS names_free FROM v",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = for_spark(spark, sf_dir, "SELECT c_custkey AS session_id, array(" + VARIED + ") AS variants, DATE '2026-10-01' AS as_of FROM {customer}")
    made = Y.sessions(rows, hijri_months(spark), 7)
    one = lambda slot, field: F.max(F.when((F.col("slot") == slot) & (F.col("field") == field), F.col("value")))
    wide = made.groupBy("session_id", "human_expected").agg(
        F.count("value").cast("int").alias("n_values"),
        one("national_id_front", "full_name_ar").alias("full"),
        one("commercial_registration", "owner_name_ar").alias("owner"),
        one("tax_card", "holder_name_ar").alias("holder"),
        one("commercial_registration", "business_name_ar").alias("business"),
        one("tax_card", "business_name_ar").alias("tax_business"),
        one("commercial_registration", "expiry_date").alias("expiry"),
        one("national_id_back", "date_of_birth").alias("birth"),
        one("national_id_front", "id_number").alias("id_number"),
        one("national_id_back", "family_number").alias("family_number"),
        one("commercial_registration", "registration_number").alias("registration_number"),
        one("tax_card", "tax_number").alias("tax_number"),
    )
    western = lambda c: F.translate(c, ARABIC_DIGITS[:10], "0123456789")
    same = lambda a, b: normalized(F.col(a)) == normalized(F.col(b))
    hijri = F.col("expiry").contains("هـ")
    patterns = {"id_number": r"^\d{12}$", "family_number": "^[0-9A-Z]{10,18}$", "registration_number": r"^\d{2}/\d{5,6}$", "tax_number": r"^\d{9}$"}
    valid = F.lit(True)
    for c, pattern in patterns.items():
        valid = valid & F.rlike(western(F.col(c)), F.lit(pattern))
    parts = F.split("full", " ")
    free = (F.size(F.array_distinct(F.slice(parts, 1, 3))) == 3) & ~F.concat_ws("/", parts[0], parts[1]).isin(["/".join(b) for b in Y.BLOCKED])
    return wide.select(
        "session_id",
        "human_expected",
        "n_values",
        same("full", "owner").alias("same_owner"),
        same("full", "holder").alias("same_holder"),
        same("business", "tax_business").alias("same_business"),
        F.when(hijri, False).otherwise(western(F.col("expiry")) <= "2026/10/01").alias("expired"),
        (western(F.col("birth")) > "2008/10/01").alias("underage"),
        hijri.alias("hijri"),
        F.col("id_number").rlike(f"[{ARABIC_DIGITS[:10]}]").alias("arabic_digits"),
        valid.alias("numbers_valid"),
        free.alias("names_free"),
    )


#: Every seventh status is no code, every eleventh kind is missing (and becomes the default), every thirteenth confidence no number.
SESSION_ROWS = "SELECT CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_custkey % 8 AS STRING) END AS tenant_id, CASE WHEN o_orderkey % 11 <> 0 THEN 'document' END AS kind, CASE WHEN o_orderkey % 7 = 0 THEN 'unheard' ELSE 'created' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN '[\"a\"' ELSE '[\"a\"]' END AS slots, '1' AS ruleset_version, CASE WHEN o_orderkey % 13 = 0 THEN 'high' ELSE CAST(o_custkey % 100 AS STRING) END AS session_confidence FROM {orders}"


@R.add(
    "src_12_table_contracts",
    "WITH fx AS (" + SESSION_ROWS + "), p AS (SELECT *, concat_ws(',', CASE WHEN status = 'unheard' THEN 'code:status' END, CASE WHEN NOT json_valid(slots) THEN 'json:slots' END, CASE WHEN tenant_id IS NULL THEN 'null:tenant_id' END, CASE WHEN TRY_CAST(session_confidence AS DOUBLE) IS NULL THEN 'type:session_confidence' END) AS problems FROM fx) "
    "SELECT id, problems, CASE WHEN problems = '' THEN tenant_id END AS tenant_id, CASE WHEN problems = '' THEN coalesce(kind, 'kyc') END AS kind, CASE WHEN problems = '' THEN CAST(session_confidence AS DOUBLE) END AS session_confidence FROM p",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tables")
    S.append_table(for_spark(spark, sf_dir, SESSION_ROWS), "sessions", path)
    good = S.scan_table(spark, "sessions", path).select("id", F.lit("").alias("problems"), "tenant_id", "kind", "session_confidence")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("tenant_id", "string"), ("kind", "string"), ("session_confidence", "double"))]
    return good.unionByName(S.rejected_rows(spark, "sessions", path).select(F.get_json_object("raw", "$.id").alias("id"), F.array_join("problems", ",").alias("problems"), *none))


MESSY_REPLIES = (
    "SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'no object at all' WHEN 2 THEN '{{\"total\": ' || CAST(o_custkey AS STRING) WHEN 3 THEN '{{\"total\": }}' WHEN 4 THEN '<think>{{maybe}}</think>```json\n{{\"total\": ' || CAST(o_custkey AS STRING) || ', \"buyer\": {{\"name\": \"n\"}}, \"tags\": [\"x\", 2]}}\n```' "
    "WHEN 5 THEN 'Here: {{\"total\": \"' || CAST(o_custkey AS STRING) || '\", \"buyer\": 7}} done' WHEN 6 THEN '  ' ELSE '{{\"total\": {{\"of\": 1}}, \"tags\": []}}' END AS reply FROM {orders}"
)


@R.add(
    "txt_15_parse_json",
    "WITH fx AS (" + MESSY_REPLIES + "), o AS (SELECT id, reply, regexp_extract(replace(replace(regexp_replace(reply, '<think>.*?</think>', '', 'gs'), '```json', ''), '```', ''), '\\{{.*\\}}', 0, 's') AS j FROM fx), "
    "v AS (SELECT id, CASE WHEN trim(coalesce(reply, '')) = '' THEN 'no_reply' WHEN j = '' THEN 'no_object' WHEN NOT json_valid(j) THEN 'not_json' END AS error, CASE WHEN json_valid(j) THEN j END AS j FROM o) "
    "SELECT id, error, TRY_CAST(json_extract_string(j, '$.total') AS BIGINT) AS total, json_extract_string(j, '$.buyer.name') AS buyer, json_extract_string(j, '$.tags[0]') AS tag FROM v",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = for_spark(spark, sf_dir, MESSY_REPLIES).select("id", parsed_reply(F.col("reply")).alias("r"))
    value = lambda path, kind: reply_value(F.col("r"), path, kind)
    return parsed.select("id", "r.error", value("$.total", "bigint").alias("total"), value("$.buyer.name", "string").alias("buyer"), value("$.tags[0]", "string").alias("tag"))


PRINTED = "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'hijri' ELSE 'gregorian' END AS calendar FROM {orders}"


@R.add(
    "txt_18_format_date",
    # a Hijri date is checked by reading it again: SQL has no such calendar
    "WITH fx AS (" + PRINTED + ") SELECT id, CASE WHEN calendar = 'gregorian' THEN strftime(day, '%Y/%m/%d') END AS printed, calendar = 'hijri' AS marked, day AS read_again FROM fx",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = dates.with_printed_date(for_spark(spark, sf_dir, PRINTED), "day", "calendar")
    again = dates.with_parsed_date(printed, "printed")
    return again.select("id", F.when(F.col("calendar") == "gregorian", F.col("printed")).alias("printed"), F.col("printed").contains("هـ").alias("marked"), F.col("parsed.value").alias("read_again"))
