"""Operational tables as set-based jobs: versions, queues, reminders, retention, webhooks, keys, audit chains."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fieldtrust.functions.text import western_digits
from fieldtrust.operators.scan import Fold, folded, with_previous

# fixed values: seconds between delivery attempts, and how long they go on
RETRY_SECONDS, RETRY_HOURS = [30, 120, 600, 1800, 3600, 7200, 14400], 24
GENESIS = "0" * 64
#: Session status moves that may happen (fixed values).
MOVES = [
    ("created", "submitted"),
    ("submitted", "processing"),
    ("submitted", "failed"),
    ("processing", "needs_review"),
    ("processing", "completed"),
    ("processing", "failed"),
    ("needs_review", "completed"),
    ("needs_review", "retake_requested"),
    ("retake_requested", "submitted"),
]


def tenant_view(df: DataFrame, tenant: str | None) -> DataFrame:
    """The tenant's rows; none without a tenant. tenant_id is the partition column, so files of others are not read."""
    return df.where(F.col("tenant_id") == F.lit(tenant)) if tenant else df.where(F.lit(False))


def current_documents(documents: DataFrame) -> DataFrame:
    return documents.where(~F.col("superseded")).orderBy("session_id", "created_at", "slot")


def missing_uploads(slots: DataFrame, objects: DataFrame) -> DataFrame:
    """Awaited slots (session_id, slot) for which no object lies in the store."""
    return slots.where("status = 'awaiting_upload'").join(objects.select("session_id", "slot"), ["session_id", "slot"], "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value, source, version after new values replace or join the old ones; only touched rows get a new version."""
    o, n = old.select(*keys, F.col("value").alias("_v"), F.col("source").alias("_s"), F.col("version").alias("_n")), new.select(*keys, "value", "source", F.lit(True).alias("_new"))
    both = o.join(n, keys, "full")
    fresh = F.col("_new").isNotNull()
    return both.select(*keys, F.when(fresh, F.col("value")).otherwise(F.col("_v")).alias("value"), F.when(fresh, F.col("source")).otherwise(F.col("_s")).alias("source"), (F.coalesce("_n", F.lit(0)) + fresh.cast("int")).alias("version"))


def appended_history(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that upserted() adds to the history: keys, value, source, version of each new value."""
    before = old.select(*keys, F.col("version").alias("_n"))
    return new.select(*keys, "value", "source").join(before, keys, "left").select(*keys, "value", "source", (F.coalesce("_n", F.lit(0)) + 1).alias("version"))


def latest_version(history: DataFrame, keys: list[str]) -> DataFrame:
    return history.groupBy(*keys).agg(F.max(F.struct("version", "value", "source")).alias("_l")).select(*keys, "_l.value", "_l.source", "_l.version")


def session_view(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """Current documents with their fields; a corrected later version counts as ok."""
    ok = (F.col("version") > 1) & (F.col("source") == "corrected")
    return current_documents(documents).join(fields, ["session_id", "slot"]).withColumn("status", F.when(ok, "ok").otherwise(F.col("status")))


def review_queue(items: DataFrame, sessions: DataFrame, now: Column, reason: str | None = None, limit: int = 50) -> DataFrame:
    """The oldest open items with their age in seconds; limit is clamped to 1..200 and runs as a top-k."""
    open_items = items.where("state = 'open'")
    if reason is not None:
        open_items = open_items.where(F.array_contains("reasons", reason))
    aged = open_items.join(sessions, "session_id").withColumn("age_seconds", F.unix_timestamp(now) - F.unix_timestamp("created_at"))
    return aged.orderBy("created_at", "session_id").limit(max(1, min(limit, 200)))


def apply_corrections(corrections: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new versions, rejects) of corrections (session_id, values: MAP of 'slot.field'): unknown fields are rejected."""
    rows = corrections.select("session_id", F.explode("values").alias("at", "value")).withColumns({"slot": F.split_part("at", F.lit("."), F.lit(1)), "field": F.split_part("at", F.lit("."), F.lit(2))})
    known = fields.select("session_id", "slot", "field", "version").withColumn("_known", F.lit(True))
    both = rows.join(known, ["session_id", "slot", "field"], "left")
    good = both.where("_known").select("session_id", "slot", "field", "value", F.lit("corrected").alias("source"), (F.col("version") + 1).alias("version"))
    return good, both.where("_known IS NULL").select("session_id", "at", "value")


def illegal_moves(statuses: DataFrame) -> DataFrame:
    """Rows of a status log (session_id, ts, event_id, status) whose step from the one before is not allowed."""
    steps = statuses.withColumn("before", F.lag("status").over(Window.partitionBy("session_id").orderBy("ts", "event_id"))).where("before IS NOT NULL AND before <> status")
    allowed = F.broadcast(statuses.sparkSession.createDataFrame(MOVES, "before string, status string"))
    return steps.join(allowed, ["before", "status"], "left_anti")


def identifier_hash(kind: Column, value: Column, key: str) -> Column:
    """Keyed hash of a canonical identifier: HMAC-SHA256 of 'kind:value' as lower-case hex."""
    block = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    pad = lambda x: F.lit(bytes(b ^ x for b in block.ljust(64, b"\0")))
    message = F.encode(F.concat_ws(":", kind, value), "UTF-8")
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message), 256))), 256)


def lookup_hash(grp: Column, field: Column, value: Column, key: str) -> Column:
    """The hash under which an identifier is found again: of fields of digits only, with spaces and scripts made alike."""
    same = F.regexp_replace(western_digits(value), r"(?U)\s", "")
    return F.when((grp == "digits") & value.isNotNull(), identifier_hash(field, same, key))


def find_identifier(identifiers: DataFrame, asked: DataFrame) -> DataFrame:
    """tenant_id, field, hash, session_id of the sessions that carry an identifier asked for (tenant_id, field, hash)."""
    return identifiers.join(asked.select("tenant_id", "field", "hash").distinct(), ["tenant_id", "field", "hash"], "left_semi").select("tenant_id", "field", "hash", "session_id")


def duplicate_identifiers(identifiers: DataFrame) -> DataFrame:
    """tenant_id, field, hash, sessions: identifiers that more than one session of a tenant carries."""
    return identifiers.groupBy("tenant_id", "field", "hash").agg(F.count_distinct("session_id").alias("sessions")).where("sessions > 1")


def sealed(value: Column, key: Column, context: Column) -> Column:
    """Authenticated encryption of a text bound to a context; key: 16 or 32 bytes, taken from a secret column."""
    return F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), context)


def unsealed(value: Column, key: Column, context: Column) -> Column:
    """The text again; null if the context or the key is another one."""
    return F.try_aes_decrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), context).cast("string")


def expiry_reminders(days: DataFrame, lead: int = 30) -> DataFrame:
    """One scheduled reminder for each readable expiry day (session_id, slot, due)."""
    return days.where("due IS NOT NULL").select("session_id", "slot", "due", F.date_sub("due", lead).alias("notify_at"), F.lit("scheduled").alias("status"))


def rescheduled(reminders: DataFrame, days: DataFrame, lead: int = 30) -> DataFrame:
    """reminders (session_id, slot, due, notify_at, status) after the sessions in days (session_id, slot, due) were read
    again: their scheduled ones are replaced by one for each readable expiry day, others stay."""
    again = days.select("session_id").distinct().withColumn("_again", F.lit(True))
    kept = reminders.join(again, "session_id", "left").where(~(F.coalesce("_again", F.lit(False)) & (F.col("status") == "scheduled"))).select("session_id", "slot", "due", "notify_at", "status")
    return kept.unionByName(expiry_reminders(days, lead))


def cancelled(reminders: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reminders with those asked for (session_id, slot) cancelled, those asked for that are not scheduled)."""
    marked = reminders.join(asked.select("session_id", "slot").distinct().withColumn("_asked", F.lit(True)), ["session_id", "slot"], "left")
    hit, open_one = F.coalesce("_asked", F.lit(False)), F.col("status") == "scheduled"
    return marked.withColumn("status", F.when(hit & open_one, "cancelled").otherwise(F.col("status"))).select(*reminders.columns), marked.where(hit & ~open_one).select("session_id", "slot", "status")


def due_reminders(reminders: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """(reminders with the due ones marked sent, an event row for each of these)."""
    due = (F.col("status") == "scheduled") & (F.col("notify_at") <= today)
    return reminders.withColumn("status", F.when(due, "sent").otherwise(F.col("status"))), reminders.where(due).select("session_id", "slot", F.lit("document.expiring").alias("event"))


def list_reminders(reminders: DataFrame, status: str | None = None, due_before: Column | None = None, limit: int = 100) -> DataFrame:
    rows = reminders if status is None else reminders.where(F.col("status") == status)
    rows = rows if due_before is None else rows.where(F.col("due") < due_before)
    return rows.orderBy("notify_at", "session_id", "slot").limit(max(1, min(limit, 500)))


def retention_sweep(documents: DataFrame, sessions: DataFrame, now: Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(stored originals to delete, superseded ones included, of kyc sessions completed before the cutoff; documents with
    those marked deleted and no longer stored)."""
    old = sessions.where((F.col("kind") == "kyc") & (F.col("status") == "completed") & (F.col("updated_at") < now - F.make_dt_interval(F.lit(days)))).select("session_id").distinct()
    marked = documents.join(old.withColumn("_old", F.lit(True)), "session_id", "left").withColumn("deleted", F.coalesce("_old", F.lit(False)) & F.col("stored"))
    updated = marked.withColumn("stored", F.col("stored") & ~F.col("deleted")).select(*documents.columns, "deleted")
    return marked.where("deleted").select("session_id", "slot"), updated


def fan_out(events: DataFrame, webhooks: DataFrame) -> DataFrame:
    """One delivery for each active subscription of the tenant that lists the event."""
    listed = webhooks.where("active").select("tenant_id", "webhook_id", F.explode("events").alias("event"))
    return events.join(listed, ["tenant_id", "event"]).select("event_id", "webhook_id", "event")


def retry_schedule(deliveries: DataFrame) -> DataFrame:
    """Adds status and next_at: after attempts failures the next delay, the last one repeating; failed once that lies
    beyond the window from created_at. deliveries: attempts, delivered, created_at, now."""
    delay = F.element_at(F.array(*map(F.lit, RETRY_SECONDS)), F.least(F.col("attempts"), F.lit(len(RETRY_SECONDS))))
    at = F.timestamp_seconds(F.unix_timestamp("now") + delay)
    late = at > F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(RETRY_HOURS))
    status = F.when(F.col("delivered"), "delivered").when(late, "failed").otherwise("pending")
    return deliveries.withColumns({"status": status, "next_at": F.when(status == "pending", at)})


def carried(rows: DataFrame, keys: list[str], order: list[str], schema: str, start: Callable[[dict], Any], step: Callable[[Any, dict], tuple[Any, tuple]]) -> DataFrame:
    """keys and the values that step returns for each row, in the order given within its key. Spark sorts; only the
    state of the key at hand is carried from row to row (start makes it from the key's first row)."""
    kinds = rows.select(*keys).schema.add("_", StructType.fromDDL(schema))
    out_schema = StructType([*kinds.fields[:-1], *kinds["_"].dataType.fields])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            values = []
            for r in batch.to_pylist():
                key = tuple(r[k] for k in keys)
                if key != current:
                    current, state = key, start(r)
                state, value = step(state, r)
                values.append(value)
            types = to_arrow_schema(kinds["_"].dataType)
            made = list(zip(*values, strict=True)) if values else [()] * len(types)
            columns = [*(batch.column(k) for k in keys), *(pa.array(c, f.type) for c, f in zip(made, types, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=out_schema.names)

    placed = rows.repartition(*keys).sortWithinPartitions(*keys, *[F.asc_nulls_last(x) for x in order])
    return placed.mapInArrow(folded, out_schema)


class WindowStretch:
    """Requests of one key: the latest time in them. A window that ends after it stays as it is."""

    def __init__(self) -> None:
        self.last: int | None = None

    def add(self, r: dict) -> None:
        if r["micros"] is not None:
            self.last = r["micros"] if self.last is None else max(self.last, r["micros"])

    def through(self, state: tuple) -> tuple | None:
        until = state[0]
        return state if until is not None and (self.last is None or self.last < until) else None


def idempotent(requests: DataFrame, hours: int = 24) -> DataFrame:
    """Adds verdict to requests (tenant_id, key, ts, request_id, hash): run starts a window of some hours for its key;
    within it another hash is a conflict, the same one a replay. With done_at (and ok), the time at which the request was
    answered, null if never, a repetition before that is in_progress; a run that failed (ok false) frees its key at that
    time. Without these columns every request is answered at once.

    A key may have any number of rows: they are folded in ranges of time, and only ranges in which a window begins are run
    through to know where the next one stands. Rows without a time come last."""
    span, answered = hours * 3_600_000_000, "done_at" in requests.columns

    def step(state: tuple, r: dict) -> tuple[tuple, tuple]:
        until, first, done = state
        now = r["micros"]
        if until is None or (now is not None and now >= until):
            end = None if now is None else now + span
            if answered and r["ok"] is False and r["done"] is not None:
                end = r["done"] if end is None else min(end, r["done"])
            return (end, r["hash"], r["done"] if answered else now), (r["request_id"], "run")
        if first is None or first != r["hash"]:
            return state, (r["request_id"], "conflict")
        return state, (r["request_id"], "in_progress" if answered and (done is None or now is None or done > now) else "replay")

    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    more = [micros("done_at").alias("done"), (F.col("ok") if "ok" in requests.columns else F.lit(True)).alias("ok")] if answered else []
    rows = requests.select("tenant_id", "key", micros("ts").alias("micros"), F.col("request_id").cast("long").alias("request_id"), "hash", *more)
    fold = Fold(lambda r: (None, None, None), step, WindowStretch)
    return folded(rows, ["tenant_id", "key"], ["micros", "request_id", "hash"], "request_id long, verdict string", fold)


class BucketStretch:
    """Events of one key as a map of the bucket's level: at the first event (after its refill) to that after the last one.

    Levels are whole numbers, `token` of which are one token. pieces: (from, moves, value) in the order of from: a level
    from there on becomes level + value if moves, else value. Levels that agree merge again, so pieces stay few."""

    def __init__(self, rate: int, cap: int, token: int) -> None:
        self.rate, self.cap, self.token = rate, cap, token
        self.first = self.last = None
        self.pieces: list[tuple[int, bool, int]] | None = None

    def add(self, r: dict) -> None:
        now = r["micros"]
        if self.pieces is None:
            self.first, self.pieces = now, [(0, True, 0)]
        elif now is not None and self.last is not None:
            self.pieces = self.cut(self.cap, [(a, m, v + (now - self.last) * self.rate) for a, m, v in self.pieces], lambda m, v: (False, self.cap))
        if now is not None:
            self.last = now
        self.pieces = self.cut(self.token, self.pieces, lambda m, v: (m, v - self.token))

    def cut(self, edge: int, pieces: list[tuple[int, bool, int]], above: Callable) -> list[tuple[int, bool, int]]:
        """pieces with above(moves, value) in place of those parts that give at least edge."""
        out: list[tuple[int, bool, int]] = []
        for i, (a, m, v) in enumerate(pieces):
            end = pieces[i + 1][0] if i + 1 < len(pieces) else self.cap + 1
            at = max(a, edge - v) if m else (a if v >= edge else end)
            for start, stop, piece in ((a, min(at, end), (m, v)), (at, end, above(m, v))):
                if start < stop and (not out or out[-1][1:] != piece):
                    out.append((start, *piece))
        return out

    def through(self, state: tuple) -> tuple:
        level, at = state
        if self.first is not None and at is not None:
            level = min(self.cap, level + (self.first - at) * self.rate)
        _, moves, value = self.pieces[bisect_right(self.pieces, level, key=lambda p: p[0]) - 1]
        return level + value if moves else value, at if self.last is None else self.last


def rate_limit(events: DataFrame, per_minute: int) -> DataFrame:
    """event_id, allowed, wait_seconds of a token bucket for each key (key, event_id, ts), refilled evenly, full at first;
    without a limit (0) all are allowed.

    A key may have any number of rows: each range of its time is summed up as a map of the bucket's level, the maps are
    composed, and the ranges are then played from the levels they begin with. Levels are exact whole numbers (a token is
    60 million, a microsecond adds per_minute). Rows without a time come last and refill nothing."""
    token = 60_000_000
    cap = per_minute * token
    if per_minute <= 0:
        return events.select("key", F.col("event_id").cast("long").alias("event_id"), F.lit(True).alias("allowed"), F.lit(0.0).alias("wait_seconds"))

    def step(state: tuple, r: dict) -> tuple[tuple, tuple]:
        level, at = state
        now = r["micros"]
        have = level if now is None or at is None else min(cap, level + (now - at) * per_minute)
        ok = have >= token
        return (have - token * ok, at if now is None else now), (r["event_id"], ok, 0.0 if ok else (token - have) / per_minute / 1e6)

    rows = events.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.col("event_id").cast("long").alias("event_id"))
    fold = Fold(lambda r: (cap, None), step, lambda: BucketStretch(per_minute, cap, token))
    return folded(rows, ["key"], ["micros", "event_id"], "event_id long, allowed boolean, wait_seconds double", fold)


def append_audit(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """tenant_id, id, body, prev_hash, hash: each tenant's new events (tenant_id, id, body) chained to its last hash.

    A chain of hashes has no shorter way: the new events of one tenant go through one task, whose state is one hash. Run
    it by ranges of ids, each from the heads of the one before, where one tenant has more new events than a task should
    see; verify_audit() has no such limit."""
    rows = events.select("tenant_id", F.col("id").cast("long").alias("id"), "body")
    rows = rows.withColumn("head", F.lit(GENESIS)) if heads is None else rows.join(heads.select("tenant_id", F.col("hash").alias("head")), "tenant_id", "left").withColumn("head", F.coalesce("head", F.lit(GENESIS)))

    def step(head: str | None, r: dict) -> tuple[str | None, tuple]:
        digest = None if head is None or r["body"] is None else hashlib.sha256((head + r["body"]).encode()).hexdigest()
        return digest, (r["id"], r["body"], head, digest)

    return carried(rows, ["tenant_id"], ["id", "body"], "id long, body string, prev_hash string, hash string", lambda r: r["head"], step)


def verify_audit(log: DataFrame) -> DataFrame:
    """tenant_id, intact, first_bad: each stored hash is checked against its row and the one before (ids are unique within a
    tenant). A tenant's log lies in several ranges of ids; the last hash of each is handed to the next."""
    linked = with_previous(log, ["tenant_id"], ["id"], {"_before": "hash"})
    before = F.coalesce("_before", F.lit(GENESIS))
    good = (F.col("prev_hash") == before) & (F.col("hash") == F.sha2(F.concat("prev_hash", "body"), 256))
    return linked.groupBy("tenant_id").agg(F.min(F.when(~F.coalesce(good, F.lit(False)), F.col("id"))).alias("first_bad")).select("tenant_id", F.col("first_bad").isNull().alias("intact"), "first_bad")


def call_metrics(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls, failures and latency percentiles overall and by each column, in one pass by grouping sets."""
    # latencies are counted by value first: no group gathers more than the different values
    counted = calls.groupBy(*by, "latency").agg(F.count("*").alias("n"), F.count(F.when(~F.col("ok"), 1)).alias("bad"))
    return counted.groupingSets([[], *[[F.col(c)] for c in by]], *map(F.col, by)).agg(
        F.sum("n").alias("calls"), F.sum("bad").alias("failures"), F.percentile("latency", 0.5, F.col("n")).alias("p50"), F.percentile("latency", 0.95, F.col("n")).alias("p95")
    )


def active_keys(lookups: DataFrame, keys: DataFrame) -> DataFrame:
    """Lookups (token) whose hash is a key that is not revoked."""
    return lookups.withColumn("key_hash", F.sha2("token", 256)).join(keys.where("NOT revoked").select("key_hash"), "key_hash", "left_semi")


def rejected_sessions(sessions: DataFrame, known: list[str], most: int = 10) -> DataFrame:
    """session_id, problem of sessions whose slots are not 1 to `most` distinct known ones."""
    n = F.size("slots")
    problem = F.when((n < 1) | (n > most), "count").when(F.size(F.array_distinct("slots")) < n, "repeated").when(F.size(F.array_except("slots", F.array(*map(F.lit, known)))) > 0, "unknown")
    return sessions.select("session_id", problem.alias("problem")).where("problem IS NOT NULL")
