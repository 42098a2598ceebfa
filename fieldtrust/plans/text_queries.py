"""Queries of the text, name, date, extraction, validation and cross-document functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.functions import dates, names, text
from fieldtrust.operators import classify as K
from fieldtrust.operators import crossdoc as X
from fieldtrust.operators import extract as E
from fieldtrust.operators import validate as V
from fieldtrust.plans.base import Registry, for_spark, table
from fieldtrust.sources import rulesets as L

R = Registry()

PAIRS = "SELECT x.p_partkey AS id, x.p_name AS a, y.p_name AS b FROM {part} x JOIN {part} y ON y.p_partkey = x.p_partkey + 1"
DIGITS = "SELECT o_orderkey AS id, 'n' || translate(CAST(o_orderkey AS STRING), '0123456789', '٠١٢٣٤٥٦٧٨٩') || '-' || translate(CAST(o_custkey AS STRING), '0123456789', '۰۱۲۳۴۵۶۷۸۹') AS t FROM {orders}"
MIXED = "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN 'علي' WHEN 2 THEN p_name || ' كەریم' WHEN 3 THEN CAST(p_size AS STRING) ELSE 'ڕ' || CAST(p_size AS STRING) END AS t FROM {part}"
SKELETON = "lower(a)"
for _a, _b in names.ALIKE:
    SKELETON = f"replace({SKELETON}, '{_a}', '{_b}')"
SKELETON = f"regexp_replace({SKELETON}, '[aeiouyhw''\\-\\s]', '', 'g')"
for _c in "bcdfgjklmnpqrstvxz":
    SKELETON = f"regexp_replace({SKELETON}, '{_c}+', '{_c}', 'g')"
JW = "jaro + 0.1 * (1 - jaro) * (CASE WHEN substring(a, 1, 4) = substring(b, 1, 4) AND length(a) >= 4 AND length(b) >= 4 THEN 4 WHEN substring(a, 1, 3) = substring(b, 1, 3) AND length(a) >= 3 AND length(b) >= 3 THEN 3 WHEN substring(a, 1, 2) = substring(b, 1, 2) AND length(a) >= 2 AND length(b) >= 2 THEN 2 WHEN substring(a, 1, 1) = substring(b, 1, 1) THEN 1 ELSE 0 END)"


#: Jaro by its definition: matched places of a and b as a * 1000 + b, then half the number of letters out of order.
PLACES = (
    "list_reduce(list_transform(range(length(a)), lambda i: [i]), lambda s, x: list_concat(s, list_transform(list_filter(range(greatest(0, x[1] - w), least(length(b), x[1] + w + 1)), "
    "lambda j: b[j + 1] = a[x[1] + 1] AND NOT list_contains(list_transform(s, lambda t: t % 1000), j))[1:1], lambda j: x[1] * 1000 + j)), []::BIGINT[])"
)


def jaro_of(source: str) -> str:
    """Common table expressions that end in j (a, b, jaro) for the distinct pairs of source."""
    return (
        f"d AS (SELECT DISTINCT a, b, greatest(greatest(length(a), length(b)) // 2 - 1, 0) AS w FROM {source}), p AS (SELECT *, " + PLACES + " AS s FROM d), "
        "m AS (SELECT a, b, length(s) AS k, list_transform(s, lambda t: a[t // 1000 + 1]) AS x, list_transform(list_sort(list_transform(s, lambda t: t % 1000)), lambda j: b[j + 1]) AS y FROM p), "
        "j AS (SELECT a, b, CASE WHEN k = 0 THEN 0.0 ELSE (k * 1.0E0 / length(a) + k * 1.0E0 / length(b) + (k - length(list_filter(range(k), lambda i: x[i + 1] <> y[i + 1])) / 2.0E0) / k) / 3 END AS jaro FROM m)"
    )


def fx(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return for_spark(spark, sf_dir, sql)


def over(sql: str, select: str) -> str:
    return "WITH fx AS (" + sql + ") SELECT " + select + " FROM fx"


@R.add("txt_01_western_digits", "SELECT o_orderkey AS id, 'n' || o_orderkey || '-' || o_custkey AS v FROM {orders}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx(spark, sf_dir, DIGITS).select("id", text.western_digits(F.col("t")).alias("v"))


@R.add("txt_02_is_kurdish", "SELECT p_partkey AS id, p_partkey % 5 IN (2, 4) AS v FROM {part}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx(spark, sf_dir, MIXED).select("id", text.is_kurdish(F.col("t")).alias("v"))


@R.add("txt_03_script_of", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'latin' WHEN 2 THEN 'mixed' WHEN 3 THEN 'none' ELSE 'arabic' END AS v FROM {part}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx(spark, sf_dir, MIXED).select("id", text.script_of(F.col("t")).alias("v"))


@R.add("txt_04_normalize", "SELECT doc_id AS id, md5(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g'))) AS v FROM {documents}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(text.normalized(F.col("text"))).alias("v"))


@R.add("txt_05_edit_distance", over(PAIRS, "id, levenshtein(a, b)::INT AS v"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx(spark, sf_dir, PAIRS).select("id", F.levenshtein("a", "b").alias("v"))


@R.add("txt_06_similarity", over(PAIRS, "id, round(CASE WHEN a = b THEN 1.0 ELSE 1 - levenshtein(a, b) * 1.0E0 / greatest(length(a), length(b)) END, 6)::DOUBLE AS v"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx(spark, sf_dir, PAIRS).select("id", F.round(text.similarity(F.col("a"), F.col("b")), 6).alias("v"))


@R.add("txt_07_cer", over(PAIRS, "id, round(levenshtein(a, b) * 1.0E0 / length(a), 6) AS v"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx(spark, sf_dir, PAIRS).select("id", F.round(text.character_error_rate(F.col("a"), F.col("b")), 6).alias("v"))


@R.add("txt_08_jaro_winkler", "WITH fx AS (" + PAIRS + "), " + jaro_of("fx") + f" SELECT id, round({JW}, 6) AS v FROM fx JOIN j USING (a, b)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    # names repeat: each distinct pair is compared once
    pairs = fx(spark, sf_dir, PAIRS)
    known = pairs.select("a", "b").distinct().withColumn("v", F.round(text.jaro_winkler(F.col("a"), F.col("b")), 6))
    return pairs.join(known, ["a", "b"]).select("id", "v")


@R.add("txt_10_skeleton", over("SELECT p_partkey AS id, p_name || ' ' || p_type AS a FROM {part}", f"id, {SKELETON} AS v"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), names.consonants(F.lower(F.concat_ws(" ", "p_name", "p_type"))).alias("v"))


@R.add("txt_11_name_tokens", "SELECT p_partkey AS id, array_to_string(list_filter(string_split(lower(p_name), ' '), lambda x: x <> ''), '|') AS v FROM {part}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(text.tokens(text.normalized(F.concat_ws("  ", F.lit(""), "p_name"))), "|").alias("v"))


NAMED = "SELECT x.p_partkey AS id, x.p_name AS na, CASE WHEN x.p_partkey % 3 = 0 THEN y.p_name ELSE split_part(x.p_name, ' ', 1) || ' ' || split_part(y.p_name, ' ', 2) END AS nb FROM {part} x JOIN {part} y ON y.p_partkey = x.p_partkey + 1"


@R.add(
    "txt_12_match_names",
    "WITH fx AS (" + NAMED + "), s AS (SELECT id, split_part(na, ' ', 1) = split_part(nb, ' ', 1) AS same, split_part(na, ' ', 2) AS a, split_part(nb, ' ', 2) AS b FROM fx), "
    + jaro_of("s") + ", g AS (SELECT id, same, " + JW + " AS jw FROM s JOIN j USING (a, b)) SELECT id, CASE WHEN same AND jw >= 0.92 THEN 'match' ELSE 'mismatch' END AS status, round(CASE WHEN same AND jw >= 0.92 THEN (1 + jw) / 2 ELSE 0 END, 6)::DOUBLE AS score FROM g",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.with_name_match(fx(spark, sf_dir, NAMED), "na", "nb").select("id", "name_match.status", F.round("name_match.score", 6).alias("score"))


PRINTED = """
SELECT l_orderkey, l_linenumber, CASE l_orderkey % 3 WHEN 0 THEN replace(d, '-', '/') WHEN 1 THEN substring(d, 9, 2) || '-' || substring(d, 6, 2) || '-' || substring(d, 1, 4) ELSE substring(d, 1, 4) || '/13/40' END AS t, d
FROM (SELECT l_orderkey, l_linenumber, CAST(CAST(l_shipdate AS DATE) AS STRING) AS d FROM {lineitem})
"""


@R.add("txt_13_parse_date", over(PRINTED, "l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 < 2 THEN CAST(d AS DATE) END AS v, CASE WHEN l_orderkey % 3 < 2 THEN 'gregorian' END AS calendar"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx(spark, sf_dir, PRINTED)
    known = dates.with_parsed_date(rows.select("t").distinct(), "t")
    return rows.join(known, "t").select("l_orderkey", "l_linenumber", F.col("parsed.value").alias("v"), "parsed.calendar")


LINE = "SELECT o_orderkey AS id, CAST(o_orderkey AS STRING) || ' ' || o_orderstatus AS value, 'Key:  ' || translate(CAST(o_orderkey AS STRING), '0123456789', '٠١٢٣٤٥٦٧٨٩') || '   ' || CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS line FROM {orders}"


@R.add("txt_14_locate", over(LINE, "id, CASE WHEN id % 4 <> 0 THEN substring(line, 7) END AS v"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx(spark, sf_dir, LINE).select("id", text.located(F.col("value"), F.col("line")).alias("v"))


@R.add("txt_17_strip_values", "SELECT doc_id AS id, md5(regexp_replace(text, '[0-9]', '', 'g')) AS v FROM {documents}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(text.without_values(F.col("text"))).alias("v"))


LINES = """
SELECT o_orderkey AS session_id, 'order' AS slot, pos, CASE pos WHEN 1 THEN 'L1' WHEN 2 THEN 'L1' ELSE NULL END AS line_id,
       CASE pos WHEN 1 THEN 'Number: ' || o_orderkey WHEN 2 THEN 'Priority : ' || o_orderpriority WHEN 3 THEN '  '
                WHEN 4 THEN 'Placed:' || CAST(CAST(o_orderdate AS DATE) AS STRING) ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'Priority: ' || o_orderstatus ELSE 'no label here' END END AS text
FROM {orders} CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS p(pos)
"""


@R.add("ext_01_explode_lines", over(LINES, "session_id, slot, pos, CASE pos WHEN 1 THEN 'L1' WHEN 2 THEN 'L1_2' ELSE 'L' || pos END AS line_id, text") + " WHERE pos <> 3")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.named_lines(fx(spark, sf_dir, LINES), ["session_id", "slot"])


LABELS = "(VALUES ('number', 'number'), ('priority', 'priority'), ('placed', 'placed'), ('seal', 'seal')) AS f(field, label)"


@R.add(
    "ext_02_label_values",
    "WITH fx AS (" + LINES + "), v AS (SELECT session_id, slot, pos, lower(trim(regexp_extract(text, '^\\s*(.+?)\\s*[:：]\\s*(.*)$', 1))) AS label, regexp_extract(text, '^\\s*(.+?)\\s*[:：]\\s*(.*)$', 2) AS value FROM fx WHERE trim(text) <> ''), "
    "b AS (SELECT session_id, slot, label, arg_max(value, pos) AS value FROM v WHERE value <> '' GROUP BY ALL) SELECT s.session_id, s.slot, f.field, b.value, CASE WHEN b.value IS NULL THEN 'not_present' END AS reason "
    "FROM (SELECT DISTINCT session_id, slot FROM fx) s CROSS JOIN " + LABELS + " LEFT JOIN b ON b.session_id = s.session_id AND b.label = f.label",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = spark.createDataFrame([("order", f, f) for f in ("number", "priority", "placed", "seal")], "slot string, field string, norm_label string")
    return E.label_values(fx(spark, sf_dir, LINES), specs, ["session_id", "slot"])


CLAIMS = "SELECT o_orderkey AS session_id, 'order' AS slot, 'placed' AS field, CASE WHEN o_orderkey % 6 = 0 THEN 'nowhere' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS value, CASE WHEN o_orderkey % 2 = 0 THEN 4 ELSE 1 END AS cited FROM {orders}"


@R.add("ext_04_verify_copy_only", over(CLAIMS, "session_id, slot, field, CASE WHEN session_id % 6 <> 0 THEN value END AS value, CASE WHEN session_id % 6 = 0 THEN 'not_verbatim' END AS reason, CASE WHEN session_id % 6 <> 0 THEN 4 END AS line"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.verified_values(fx(spark, sf_dir, CLAIMS), fx(spark, sf_dir, LINES).where("trim(text) <> ''"), ["session_id", "slot"])


MARKED = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority || '?' WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS value FROM {orders}"


@R.add("ext_05_finish_reading", over(MARKED, "id, CASE WHEN value LIKE '%?%' THEN NULL ELSE value END AS value, CASE WHEN value LIKE '%?%' THEN value END AS raw_partial, CASE WHEN value LIKE '%?%' THEN 'illegible' END AS reason"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.finished(fx(spark, sf_dir, MARKED))


METRICS = "SELECT p_partkey AS id, 400 + p_size * 20 AS short_side, p_retailprice % 300 AS sharpness, p_size * 4.0E0 AS brightness, (p_partkey % 40) / 100.0E0 AS dark, (p_partkey % 37) / 100.0E0 AS bright, (p_partkey % 5) / 100.0E0 AS glare, p_partkey % 6 <> 0 AS found, (p_partkey % 23) / 1000.0E0 AS edge, (p_partkey % 11) / 200.0E0 AS skin FROM {part}"


@R.add(
    "ext_11_quality_issues",
    over(METRICS, "id, array_to_string(list_filter([CASE WHEN short_side < 600 THEN 'low_resolution' END, CASE WHEN sharpness < 50 THEN 'blur' END, CASE WHEN brightness < 50 OR dark > 0.25 THEN 'too_dark' WHEN bright > 0.25 AND glare < 0.015 THEN 'overexposed' END, CASE WHEN glare >= 0.015 AND found THEN 'glare' END, CASE WHEN NOT found THEN 'corners_not_found' END, CASE WHEN found AND edge <= 0.01 THEN 'corner_cut' END, CASE WHEN found AND skin > 0.04 THEN 'possible_occlusion' END], lambda x: x IS NOT NULL), ',') AS issues"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx(spark, sf_dir, METRICS).select("id", F.array_join(E.quality_issues(), ",").alias("issues"))


BOXES = "SELECT DISTINCT l_orderkey AS capture, CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS field, l_partkey % 90 - 5 AS x0, l_suppkey % 90 - 5 AS y0, l_partkey % 90 + 15 AS x1, l_suppkey % 90 + 7 AS y1 FROM {lineitem}"
#: Two obstacles for each line of a capture; many overlap each other.
OBSTACLES = "SELECT l_orderkey AS capture, CAST(l_quantity AS BIGINT) + k * 7 AS ox0, l_partkey % 60 + k * 5 AS oy0, CAST(l_quantity AS BIGINT) + k * 7 + 12 AS ox1, l_partkey % 60 + k * 5 + 14 AS oy1 FROM {lineitem} CROSS JOIN (VALUES (0), (1)) AS v(k)"


@R.add(
    "ext_12_occluded_fields",
    # the union is counted by unit squares: all corners are integers
    "WITH fx AS (SELECT *, greatest(x0, 0) AS a0, greatest(y0, 0) AS b0, least(x1, 80) AS a1, least(y1, 80) AS b1 FROM (" + BOXES + ")), o AS (SELECT DISTINCT * FROM (" + OBSTACLES + ")), "
    "r AS (SELECT capture, field, greatest(a0, ox0) AS c0, greatest(b0, oy0) AS d0, least(a1, ox1) AS c1, least(b1, oy1) AS d1 FROM fx JOIN o USING (capture)), "
    "q AS (SELECT capture, field, c0, d0, c1, d1, unnest(range(c0, c1)) AS x FROM r WHERE c0 < c1 AND d0 < d1), s AS (SELECT capture, field, count(*) AS n FROM (SELECT DISTINCT capture, field, x, unnest(range(d0, d1)) AS y FROM q) GROUP BY ALL), "
    "v AS (SELECT capture, field, greatest(a1 - a0, 0) * greatest(b1 - b0, 0) AS seen, (x1 - x0) * (y1 - y0) AS area FROM fx) "
    "SELECT v.capture, v.field, round(seen * 1.0E0 / area, 6) AS visible, round(CASE WHEN seen > 0 THEN coalesce(n, 0) * 1.0E0 / seen ELSE 0 END, 6) AS covered, seen * 10 < area * 9 OR (seen > 0 AND coalesce(n, 0) * 4 >= seen) AS unreadable FROM v LEFT JOIN s USING (capture, field)",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.occluded_fields(fx(spark, sf_dir, BOXES), fx(spark, sf_dir, OBSTACLES), ["capture"], (0, 0, 80, 80))
    return found.withColumns({"visible": F.round("visible", 6), "covered": F.round("covered", 6)})


DAYS = "SELECT l_orderkey AS session_id, l_linenumber AS slot, CAST(l_shipdate AS DATE) AS issue, CAST(CAST(substring(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 4) AS INT) + 10 AS STRING) || '-' || lpad(CAST(l_partkey % 12 + 1 AS STRING), 2, '0') || '-15' AS expiry_text FROM {lineitem}"


@R.add("val_04_lifetime_check", over(DAYS, "session_id, slot, abs(date_diff('day', issue + INTERVAL 10 YEAR, CAST(expiry_text AS DATE))) > 30 AS odd"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx(spark, sf_dir, DAYS).select("session_id", "slot", V.lifetime_odd(F.col("issue"), F.col("expiry_text").cast("date")).alias("odd"))


@R.add(
    "val_03_date_rules",
    "WITH fx AS (" + DAYS + "), r AS (SELECT session_id, slot, issue, CAST(expiry_text AS DATE) AS expiry, DATE '2009-06-01' AS today FROM fx) "
    "SELECT session_id, slot, 'document_expired' AS code, 'fail' AS severity FROM r WHERE expiry <= today UNION ALL SELECT session_id, slot, 'issue_in_future', 'warn' FROM r WHERE issue > today UNION ALL SELECT session_id, slot, 'issue_after_expiry', 'warn' FROM r WHERE issue >= expiry "
    "UNION ALL SELECT session_id, slot, 'underage', 'fail' FROM r WHERE issue <= today AND issue + INTERVAL 18 YEAR > today UNION ALL SELECT session_id, slot, 'dob_in_future', 'warn' FROM r WHERE issue > today",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = fx(spark, sf_dir, DAYS).select("session_id", "slot", "issue", F.col("expiry_text").cast("date").alias("expiry"), F.col("issue").alias("birth"))
    return V.date_rules(days, F.lit("2009-06-01").cast("date")).select("session_id", "slot", "code", "severity")


@R.add(
    "val_03_date_statuses",
    "WITH fx AS (" + DAYS + "), r AS (SELECT session_id, slot, issue, CAST(expiry_text AS DATE) AS expiry, DATE '2002-06-01' AS today FROM fx) SELECT session_id, slot, 'issue_date' AS field, CASE WHEN max(CAST(issue > today AS INT)) = 1 THEN 'invalid_format' ELSE 'ok' END AS status, 'gregorian' AS calendar FROM r GROUP BY session_id, slot "
    "UNION ALL SELECT session_id, slot, 'expiry_date', CASE WHEN max(CAST(expiry <= today AS INT)) = 1 THEN 'expired' ELSE 'ok' END, 'gregorian' FROM r GROUP BY session_id, slot",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["session_id", "slot"]
    days = fx(spark, sf_dir, DAYS).select(*keys, "issue", F.col("expiry_text").cast("date").alias("expiry"), F.lit(None).cast("date").alias("birth"))
    rules = V.date_rules(days, F.lit("2002-06-01").cast("date"))
    named = days.select(*keys, F.explode(F.array(F.lit("issue_date"), F.lit("expiry_date"))).alias("field")).distinct()
    read = named.withColumns({"calendar": F.lit("gregorian"), "converted": F.lit(False)})
    return V.dated_fields(named.withColumn("status", F.lit("ok")), read, rules, keys).select(*keys, "field", "status", "calendar")


@R.add("val_01_check_format", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE regexp_matches(CAST(o_orderkey * 37 AS STRING), '^[0-9]{{4,5}}$') END AS valid FROM {orders}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("o_orderkey") % 7 != 0, F.concat_ws(" ", F.substring((F.col("o_orderkey") * 37).cast("string"), 1, 2), F.substring((F.col("o_orderkey") * 37).cast("string"), 3, 30)))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), V.format_valid(value, F.lit("digits"), F.lit(r"\d{4,5}"), F.lit(None)).alias("valid"))


@R.add("val_02_check_enum", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority IN ('1-URGENT', '2-HIGH') END AS in_enum FROM {orders}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = spark.createDataFrame([("order", "priority", "1-urgent"), ("order", "priority", "2-high")], "slot string, field string, norm_member string")
    values = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("slot"), F.lit("priority").alias("field"), F.when(F.col("o_orderkey") % 7 != 0, F.lower("o_orderpriority")).alias("norm"))
    return V.enum_valid(values, members).select("id", "in_enum")


#: Two documents of a session: the order and the least value of its lines; both carry a status and a day.
DOCS = "SELECT o_orderkey AS session_id, 'card_front' AS slot, 'name' AS field, o_orderpriority AS value FROM {orders} UNION ALL SELECT l_orderkey, 'licence', 'owner', CASE WHEN l_orderkey % 3 = 0 THEN o_orderpriority WHEN l_orderkey % 3 = 1 THEN o_orderpriority || 's' ELSE l_returnflag END FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey"


@R.add(
    "xdc_02_pair_rules",
    "WITH l AS (SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN o_orderpriority WHEN l_orderkey % 3 = 1 THEN o_orderpriority || 's' ELSE l_returnflag END AS v, o_orderpriority AS p FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey), "
    "m AS (SELECT l_orderkey, min(v) AS v, min(p) AS p FROM l GROUP BY l_orderkey), s AS (SELECT o_orderkey AS session_id, v, round(CASE WHEN v = p THEN 1.0 ELSE 1 - levenshtein(lower(v), lower(p)) * 1.0E0 / greatest(length(v), length(p)) END, 3)::DOUBLE AS score FROM {orders} LEFT JOIN m ON l_orderkey = o_orderkey) "
    "SELECT session_id, 'owner_is_holder' AS rule, CASE WHEN v IS NULL THEN 'skipped' WHEN score >= 0.85 THEN 'match' ELSE 'mismatch' END AS status, CASE WHEN v IS NULL THEN NULL ELSE score END AS score FROM s",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = spark.createDataFrame([("card_front", "name"), ("licence", "owner"), ("card_back", "day")], "slot string, field string")
    rules = [X.PairRule("owner_is_holder", "card.name", "licence.owner", "normalized_fuzzy", 0.85)]
    found = X.pair_rules(fx(spark, sf_dir, DOCS).dropDuplicates(["session_id", "slot", "field", "value"]).groupBy("session_id", "slot", "field").agg(F.min("value").alias("value")), X.resolved(spark, rules, specs))
    return found.select("session_id", "rule", "status", "score")


EXPIRY = "SELECT l_orderkey AS session_id, 'doc' || l_linenumber AS slot, 'expiry_date' AS field, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS day FROM {lineitem}"


@R.add(
    "xdc_03_after_today",
    "WITH fx AS (" + EXPIRY + ") SELECT session_id, CASE WHEN bool_or(coalesce(day <= DATE '1997-01-01', false)) THEN 'fail' ELSE 'pass' END AS status, coalesce(string_agg(CASE WHEN day <= DATE '1997-01-01' THEN slot || '.' || field || ' ' || day END, ', ' ORDER BY slot, day), '') AS detail FROM fx GROUP BY session_id",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.after_today(fx(spark, sf_dir, EXPIRY), F.lit("1997-01-01").cast("date"))


SPELLED = "SELECT p_partkey AS id, translate(lower(p_name), 'abdfhjklmnqrstwyzeioucgpvx', 'ابدفهجكلمنقرستويزثخذشغصضطظع') AS t FROM {part}"
LATIN = "t"
for _letter, _latin in names.LETTERS.items():
    LATIN = f"replace({LATIN}, '{_letter}', '{_latin}')"


@R.add("txt_09_transliterate", over(SPELLED, f"id, {LATIN} AS latin"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = text.with_normalized(fx(spark, sf_dir, SPELLED), "t", "norm")
    return known.select("id", names.latin_spelling(F.col("norm")).alias("latin"))


PIECES = "SELECT o_orderkey AS id, CAST(o_orderkey + 100000 AS STRING) AS number, -(o_orderkey % 7) / 10.0E0 AS sure, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey + 100000 AS STRING) WHEN 1 THEN 'al: ' WHEN 2 THEN 'nowhere' ELSE ' end' END AS fragment FROM {orders}"


@R.add("txt_16_span_confidence", over(PIECES, "id, round(CASE id % 4 WHEN 0 THEN exp(sure) WHEN 1 THEN exp((-0.5 - 0.25) / 2) WHEN 3 THEN exp(-1.0) END, 6) AS confidence"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    piece = lambda token, p: F.struct(token.alias("token"), p.alias("logprob"))
    rows = fx(spark, sf_dir, PIECES)
    pieces = F.array(piece(F.lit("total"), F.lit(-0.5)), piece(F.lit(": "), F.lit(-0.25)), piece(F.col("number"), F.col("sure").cast("double")), piece(F.lit(" end"), F.lit(-1.0)))
    return rows.select("id", F.round(text.span_confidence(pieces, F.concat(F.lit("total: "), "number", F.lit(" end")), F.col("fragment")), 6).alias("confidence"))


CARRIED = "SELECT DISTINCT l_orderkey AS session_id, CASE l_linenumber % 4 WHEN 0 THEN 'national_id_front' WHEN 1 THEN 'commercial_registration' WHEN 2 THEN 'tax_card' ELSE 'national_id_back' END AS slot, CASE l_partkey % 5 WHEN 0 THEN 'full_name_ar' WHEN 1 THEN 'owner_name_ar' WHEN 2 THEN 'holder_name_ar' WHEN 3 THEN 'business_name_ar' ELSE 'expiry_date' END AS field FROM {lineitem}"


@R.add(
    "xdc_01_resolve_refs",
    "WITH fx AS (" + CARRIED + "), refs(rule, side, doc, name) AS (VALUES ('name_id_vs_license', 'left', 'national_id', 'full_name_ar'), ('name_id_vs_license', 'right', 'commercial_registration', 'owner_name_ar'), ('name_id_vs_tax', 'left', 'national_id', 'full_name_ar'), "
    "('name_id_vs_tax', 'right', 'tax_card', 'holder_name_ar'), ('business_name_license_vs_tax', 'left', 'commercial_registration', 'business_name_ar'), ('business_name_license_vs_tax', 'right', 'tax_card', 'business_name_ar')) "
    # national_id stands for its two sides, of which the front has the name
    "SELECT session_id, rule, side, slot FROM fx JOIN refs ON field = name AND (slot = doc OR (starts_with(slot, doc || '_') AND slot = 'national_id_front'))",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = X.resolved(spark, L.load_ruleset(spark).pairs, L.field_specs(spark))
    side = lambda s: rules.select("rule", F.lit(s).alias("side"), F.col(f"{s}_slot").alias("slot"), F.col(f"{s}_field").alias("field"))
    return fx(spark, sf_dir, CARRIED).join(F.broadcast(side("left").unionByName(side("right"))), ["slot", "field"]).select("session_id", "rule", "side", "slot")


SUPPLIED = "SELECT o_orderkey AS id, 'tax_card' AS type, (o_custkey % 10) / 10.0E0 AS confidence, CASE o_orderkey % 3 WHEN 0 THEN 1.58E0 WHEN 1 THEN 1.41E0 END AS aspect, CASE o_custkey % 4 WHEN 0 THEN 'commercial_registration' WHEN 1 THEN 'national_id_back' WHEN 2 THEN 'passport' END AS model_type, (o_custkey % 30) / 10.0E0 - 1 AS model_confidence FROM {orders}"


@R.add(
    "ext_08_reconcile_label",
    "WITH fx AS (" + SUPPLIED + "), u AS (SELECT *, coalesce((model_type = 'commercial_registration' AND (aspect IS NULL OR aspect = 1.41)) OR (model_type = 'national_id_back' AND (aspect IS NULL OR aspect = 1.58)), false) AS used FROM fx) "
    "SELECT id, CASE WHEN used THEN model_type ELSE type END AS type, round(CASE WHEN used THEN greatest(0, least(1, model_confidence)) ELSE confidence END, 6) AS confidence FROM u",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx(spark, sf_dir, SUPPLIED)
    types = L.doc_types(spark).select(F.col("slot").alias("type"), "shape")
    model = rows.where("model_type is not null").select("id", "model_type", F.col("model_confidence").cast("double"))
    return K.reconciled(rows.select("id", "type", F.col("confidence").cast("double"), F.col("aspect").cast("double")), model, types, ["id"]).withColumn("confidence", F.round("confidence", 6))
