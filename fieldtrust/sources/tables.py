"""Sources and sinks: manifests, nested truth files, images by content, relational tables with contracts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = (
    "image string, session_id string, identity_id string, slot string, split string, as_of date, variants array<string>, human_expected boolean, fields map<string,string>, handwritten array<string>, digits string, "
    "font string, field_boxes map<string,array<double>>, printed_lines array<string>, condition map<string,string>, capture string, bucket string, gt_unreadable array<string>"
)
TRUTH = "variants array<string>, as_of date, documents map<string,struct<fields:map<string,string>,glare_over:string>>"
# fixed values: the relational tables. A column ends in ! where it may not be null; json columns hold JSON texts
TABLES = {
    "tenants": "id string!, name string!, created_at timestamp!",
    "api_keys": "id string!, tenant_id string!, key_hash string!, label string!, created_at timestamp!, revoked_at timestamp",
    "sessions": "id string!, tenant_id string!, kind string!, status string!, slots json!, ruleset_version string!, external_ref string, outcome string, session_confidence double, reasons json!, result_enc binary, final_outcome string, error string, created_at timestamp!, updated_at timestamp!, submitted_at timestamp, decided_at timestamp",
    "documents": "id string!, tenant_id string!, session_id string!, slot string!, status string!, upload_key string!, object_key string, mime_type string!, sha256 string, created_at timestamp!, deleted_at timestamp",
    "fields": "id bigint!, tenant_id string!, session_id string!, document_id string!, name string!, status string!, confidence double!, value_enc binary, value_hmac string, version int!",
    "field_versions": "id bigint!, tenant_id string!, field_id bigint!, version int!, status string!, value_enc binary, source string!, actor string!, created_at timestamp!",
    "checks": "id bigint!, tenant_id string!, session_id string!, code string!, severity string!, slot string, field string, created_at timestamp!",
    "decisions": "id bigint!, tenant_id string!, session_id string!, outcome string!, session_confidence double, reasons json!, decided_by string!, pipeline_version string, created_at timestamp!",
    "review_items": "id string!, tenant_id string!, session_id string!, status string!, reasons json!, created_at timestamp!, closed_at timestamp",
    "review_actions": "id bigint!, tenant_id string!, review_item_id string!, actor string!, action string!, corrections_enc binary, retake_slots json!, note string, created_at timestamp!",
    "webhooks": "id string!, tenant_id string!, url string!, secret_enc binary!, events array<string>!, active boolean!, created_at timestamp!",
    "webhook_deliveries": "id bigint!, tenant_id string!, webhook_id string!, event string!, payload json!, status string!, locked_until timestamp, attempts int!, last_status string, next_attempt_at timestamp!, created_at timestamp!",
    "idempotency_keys": "tenant_id string!, key string!, request_hash string!, response_status int, response_body json, created_at timestamp!",
    "model_calls": "id bigint!, tenant_id string!, session_id string!, endpoint string!, model string!, purpose string!, prompt_sha256 string!, image_sha256 array<string>!, latency_ms int!, prompt_tokens int, completion_tokens int, ok boolean!, output_enc binary, error string, created_at timestamp!",
    "reminders": "id string!, tenant_id string!, session_id string, slot string, field string, kind string!, title string!, due_at date!, notify_at date!, status string!, external_ref string, created_at timestamp!, sent_at timestamp",
    "audit_log": "id bigint!, tenant_id string!, session_id string, at timestamp!, actor string!, event string!, detail json!, prev_hash string!, hash string!",
    "jobs": "id bigint!, tenant_id string!, session_id string!, status string!, attempts int!, locked_until timestamp, error string, created_at timestamp!, updated_at timestamp!",
}
# fixed values: what a missing or null column becomes; a time is the moment of the write
DEFAULTS = {
    ("api_keys", "label"): "''", ("sessions", "kind"): "'kyc'", ("sessions", "reasons"): "'[]'", ("documents", "mime_type"): "'image/jpeg'", ("fields", "version"): "1",
    ("decisions", "reasons"): "'[]'", ("review_items", "reasons"): "'[]'", ("review_actions", "retake_slots"): "'[]'", ("webhooks", "active"): "true",
    ("webhook_deliveries", "status"): "'pending'", ("webhook_deliveries", "attempts"): "0", ("webhook_deliveries", "next_attempt_at"): "current_timestamp()",
    ("model_calls", "image_sha256"): "cast(array() AS array<string>)", ("reminders", "status"): "'scheduled'", ("audit_log", "at"): "current_timestamp()", ("audit_log", "detail"): "'{}'",
    ("jobs", "status"): "'queued'", ("jobs", "attempts"): "0", ("jobs", "updated_at"): "current_timestamp()", ("sessions", "updated_at"): "current_timestamp()",
}
# fixed values: coded columns
CODES = {
    "sessions": {"kind": ["kyc", "document"], "status": ["created", "submitted", "processing", "needs_review", "completed", "retake_requested", "failed"]},
    "documents": {"status": ["awaiting_upload", "uploaded", "ingested", "superseded", "deleted"]},
    "field_versions": {"source": ["model", "reviewer"]},
    "review_items": {"status": ["open", "closed"]},
    "review_actions": {"action": ["approve", "reject", "request_retake"]},
    "webhook_deliveries": {"status": ["pending", "delivered", "failed"]},
    "reminders": {"kind": ["document_expiry", "custom"], "status": ["scheduled", "sent", "cancelled"]},
    "jobs": {"status": ["queued", "processing", "done", "failed"]},
}


class ColumnRule(NamedTuple):
    name: str
    kind: str
    needed: bool
    json: bool
    default: str | None
    codes: list[str] | None


def contract(table: str) -> list[ColumnRule]:
    """The columns of a table, in their order; an unknown table is an error."""
    if table not in TABLES:
        raise ValueError(f"unknown table: {table}")
    out = []
    for column in TABLES[table].split(", "):
        name, kind = column.rstrip("!").split(" ")
        default = DEFAULTS.get((table, name), "current_timestamp()" if name == "created_at" else None)
        out.append(ColumnRule(name, "string" if kind == "json" else kind, column.endswith("!"), kind == "json", default, CODES.get(table, {}).get(name)))
    return out


def table_schema(table: str) -> StructType:
    return StructType.fromDDL(", ".join(f"`{c.name}` {c.kind}" for c in contract(table)))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line, blank lines skipped, the schema given and never inferred."""
    return spark.read.schema(MANIFEST).json(path).where("image IS NOT NULL OR session_id IS NOT NULL")


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("split").json(path)


def load_split(rows: DataFrame, split: str) -> DataFrame:
    """Rows of tune, calibration or test; all for 'all'. split is the partition column of a written manifest."""
    if split not in ("tune", "calibration", "test", "all"):
        raise ValueError(f"unknown split: {split}")
    return rows if split == "all" else rows.where(F.col("split") == split)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """slot, field, value, glare_over of nested truth files, one row for each field."""
    docs = spark.read.option("multiLine", True).schema(TRUTH).json(path).select("as_of", F.explode("documents").alias("slot", "doc"))
    return docs.select("as_of", "slot", F.explode("doc.fields").alias("field", "value"), F.col("doc.glare_over").alias("glare_over"))


def pending_images(images: DataFrame, transcripts: DataFrame) -> DataFrame:
    """images (reader, sha256) that still need a reader: those without transcripts, or with an unavailable sample."""
    done = transcripts.groupBy("reader", "sha256").agg(F.bool_and(F.col("status") != "unavailable").alias("done")).where("done")
    return images.join(done, ["reader", "sha256"], "left_anti")


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, mime and length of files; contents stay in the tasks."""
    files = spark.read.format("binaryFile").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    mime = F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "png", "image/png").when(ext == "webp", "image/webp").otherwise("application/octet-stream")
    return files.select("path", F.sha2("content", 256).alias("sha256"), mime.alias("mime"), "length")


def checked_rows(rows: DataFrame, table: str) -> DataFrame:
    """rows by the contract of a table: its columns in its types, problems (sorted codes, empty for a good row), and raw, a bad
    row as it came (JSON).

    null:<column> where a value is needed and no default stands in; type:<column> where it cannot be cast; code:<column>
    for a value that is not listed; json:<column> for a text that is no JSON. Columns that the table lacks are passed over."""
    columns, problems = [], []
    for c in contract(table):
        given = F.col(c.name) if c.name in rows.columns else F.lit(None)
        value = given.try_cast(c.kind)
        filled = value if c.default is None else F.when(given.isNull(), F.expr(c.default).cast(c.kind)).otherwise(value)
        columns.append(filled.alias(c.name))
        problems.append(F.when(given.isNotNull() & value.isNull(), f"type:{c.name}"))
        if c.needed:
            problems.append(F.when(filled.isNull() & given.isNull(), f"null:{c.name}"))
        if c.codes:
            problems.append(F.when(value.isNotNull() & ~value.isin(c.codes), f"code:{c.name}"))
        if c.json:
            problems.append(F.when(value.isNotNull() & F.try_parse_json(value).isNull(), f"json:{c.name}"))
    found = F.array_sort(F.array_compact(F.array(*problems)))
    return rows.select(*columns, found.alias("problems"), F.when(F.size(found) > 0, F.to_json(F.struct(*rows.columns))).alias("raw"))


def append_table(rows: DataFrame, table: str, path: str) -> None:
    """Appends rows to a table under path in one pass: good ones to its tenants' folders, the others, with their problems and
    as they came, to a folder of rejects beside them."""
    checked = checked_rows(rows, table).withColumn("accepted", F.size("problems") == 0)
    tenant = ["tenant_id"] if "tenant_id" in checked.columns else []
    checked.write.mode("append").partitionBy("accepted", *tenant).parquet(f"{path}/{table}")


def _stored(spark: SparkSession, table: str, path: str) -> DataFrame:
    schema = StructType([*table_schema(table).fields, *StructType.fromDDL("problems array<string>, raw string, accepted boolean").fields])
    return spark.read.schema(schema).parquet(f"{path}/{table}")


def scan_table(spark: SparkSession, table: str, path: str, tenant: str | None = None) -> DataFrame:
    """The rows of a table in its own schema; those of one tenant by reading its folder alone."""
    rows = _stored(spark, table, path).where("accepted")
    rows = rows if tenant is None else rows.where(F.col("tenant_id") == tenant)
    return rows.select(*[c.name for c in contract(table)])


def rejected_rows(spark: SparkSession, table: str, path: str) -> DataFrame:
    """problems, raw of the rows that append_table refused."""
    return _stored(spark, table, path).where("NOT accepted").select("problems", "raw")


def write_report(metrics: DataFrame, path: str, **run: str) -> None:
    """Metric rows with the run's metadata, one folder for each run."""
    metrics.withColumns({k: F.lit(v) for k, v in run.items()}).write.mode("overwrite").partitionBy(*run).parquet(path)


def export_eval_dataset(manifest: DataFrame, specs: DataFrame) -> DataFrame:
    """id, question, answer (JSON) of each attempt of a session (its captures with one suffix _c<k>, else clean).

    The answer has the truth of every field that the slots' specs list, by slot.field in the specs' order, null where it is
    not printed or unreadable on the photo; the required and the unreadable ones; the variants, the photos' quality by slot
    and whether a person is expected. specs (slot, field, slot_order, field_order, required) is a dimension of a few rows."""
    attempt = F.coalesce(F.nullif(F.regexp_extract("capture", r"_c([^_/.]+)(?:\.[^./]*)?$", 1), F.lit("")), F.lit("clean"))
    rows = manifest.withColumns({"attempt": attempt, "gone": F.coalesce("gt_unreadable", F.array().cast("array<string>"))})
    keys = ["session_id", "attempt"]
    unreadable = F.array_contains("gone", F.col("field"))
    each = rows.select(*keys, "slot", "fields", "gone").join(F.broadcast(specs.select("slot", "field", "slot_order", "field_order", "required")), "slot")
    truth = F.struct("slot_order", "field_order", F.concat_ws(".", "slot", "field").alias("key"), F.when(~unreadable, F.try_element_at("fields", F.col("field"))).alias("value"), "required", unreadable.alias("gone"))
    listed = each.groupBy(*keys).agg(F.array_sort(F.collect_list(truth)).alias("truth"))
    page = F.array_sort(F.collect_list(F.struct("slot", "capture", "bucket")))
    pages = rows.groupBy(*keys).agg(F.max("as_of").alias("as_of"), page.alias("pages"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("variants")))).alias("variants"), F.bool_or("human_expected").alias("human_expected"))
    names = lambda test: F.transform(F.filter("truth", test), lambda t: t["key"])
    answer = F.struct(
        F.map_from_entries(F.transform("truth", lambda t: F.struct(t["key"], t["value"]))).alias("fields"),
        names(lambda t: t["required"]).alias("required"),
        names(lambda t: t["gone"]).alias("unreadable"),
        "human_expected",
        "variants",
        F.transform("pages", lambda p: p["bucket"]).alias("buckets"),
    )
    question = F.struct("as_of", F.transform("pages", lambda p: F.struct(p["slot"].alias("slot"), p["capture"].alias("capture"))).alias("documents"))
    json = {"ignoreNullFields": "false"}
    return pages.join(listed, keys, "left").withColumn("truth", F.coalesce("truth", F.slice(F.array(F.lit(None).cast(listed.schema["truth"].dataType.elementType)), 1, 0))).select(F.concat_ws("-", *keys).alias("id"), F.to_json(question, json).alias("question"), F.to_json(answer, json).alias("answer"))
