"""Streaming counterparts of the keyed operators, with state in Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from fieldtrust.operators.ops import RETRY_HOURS, RETRY_SECONDS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VERDICTS = "tenant_id string, key long, request_id long, verdict string"
LIMITS = "key long, event_id long, allowed boolean, wait_seconds double"
RETRIES = "delivery_id long, attempts int, status string, next_at timestamp"
ASSEMBLED = "session_id long, slots array<string>, complete boolean"


def _ordered(parts: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(list(by), kind="stable")


def idempotent(requests: DataFrame, hours: int = 24) -> DataFrame:
    """Verdicts (run, replay, conflict) of a stream of requests (tenant_id, key, ts, request_id, hash). The state of a
    key is the start and hash of its window and goes once the event time has passed it (with a watermark)."""
    span = pd.Timedelta(hours=hours)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        since, held = state.get if state.exists else (None, None)
        out = []
        for r in _ordered(parts, "ts", "request_id").itertuples():
            if since is None or r.ts >= pd.Timestamp(since) + span:
                since, held, verdict = r.ts.isoformat(), r.hash, "run"
            else:
                verdict = "replay" if r.hash == held else "conflict"
            out.append((key[0], int(key[1]), r.request_id, verdict))
        if since is not None:
            state.update((since, held))
            end = int((pd.Timestamp(since) + span).timestamp() * 1000)
            if end > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(end)
        yield pd.DataFrame(out, columns=["tenant_id", "key", "request_id", "verdict"])

    return requests.groupBy("tenant_id", "key").applyInPandasWithState(step, VERDICTS, "since string, hash string", "append", GroupStateTimeout.EventTimeTimeout)


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Processors with timers need the RocksDB state store; the setting holds for streams that the session starts later."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class OneTimer(StatefulProcessor):
    """A value for each key that ends by one event-time timer, moved whenever the key has new rows."""

    STATE = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", self.STATE)

    def keep(self, value: tuple, until: int, timers: TimerValues) -> None:
        """value stays until the watermark is past `until` (milliseconds)."""
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(until, timers.getCurrentWatermarkInMs() + 1))
        self.held.update(value)

    def close(self) -> None:
        pass


class Buckets(OneTimer):
    """Token buckets in whole numbers, as in the batch operator. A full bucket is what a key begins with, so the state goes
    once the watermark is past the time at which it has filled up."""

    STATE = "level long, at long"

    def __init__(self, per_minute: int) -> None:
        self.rate, self.token, self.cap = per_minute, 60_000_000, per_minute * 60_000_000

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        level, at = self.held.get() if self.held.exists() else (self.cap, None)
        out = []
        for r in _ordered(rows, "ts", "event_id").itertuples():
            now = r.ts.value // 1000
            level, at = level if at is None else min(self.cap, level + (now - at) * self.rate), now
            ok = level >= self.token
            out.append((int(key[0]), r.event_id, ok, 0.0 if ok else (self.token - level) / self.rate / 1e6))
            level -= self.token * ok
        full = at + -(-(self.cap - level) // self.rate)
        self.keep((int(level), int(at)), -(-full // 1000), timerValues)
        yield pd.DataFrame(out, columns=["key", "event_id", "allowed", "wait_seconds"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter([])


def rate_limit(events: DataFrame, per_minute: int) -> DataFrame:
    """A token bucket for each key of a stream (key, event_id, ts with a watermark), in event time. Keys whose bucket has
    filled up again leave no state."""
    keep_state_in_rocksdb(events.sparkSession)
    return events.groupBy("key").transformWithStateInPandas(Buckets(per_minute), LIMITS, "append", "eventTime")


def delivery_retries(outcomes: DataFrame) -> DataFrame:
    """delivery_id, attempts, status (delivered, pending, failed) and next_at for each outcome of a stream (delivery_id, ts,
    ok, created_at): after a failure the next attempt waits RETRY_SECONDS, failed beyond RETRY_HOURS from created_at. What
    comes after the end of a delivery is passed over; its state goes once the watermark is that many hours past it."""
    window = pd.Timedelta(hours=RETRY_HOURS)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        attempts, ended = state.get if state.exists else (0, False)
        out, last = [], None
        for r in _ordered(parts, "ts").itertuples():
            last = r.ts
            if ended:
                continue
            attempts += 1
            at = r.ts + pd.Timedelta(seconds=RETRY_SECONDS[min(attempts, len(RETRY_SECONDS)) - 1])
            status = "delivered" if r.ok else "pending" if at - r.created_at <= window else "failed"
            ended = status != "pending"
            out.append((int(key[0]), attempts, status, at if status == "pending" else pd.NaT))
        state.update((attempts, ended))
        state.setTimeoutTimestamp(max(int((last + window).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["delivery_id", "attempts", "status", "next_at"])

    return outcomes.groupBy("delivery_id").applyInPandasWithState(step, RETRIES, "attempts int, ended boolean", "append", GroupStateTimeout.EventTimeTimeout)


def scored_stream(assembled: DataFrame, transcripts: DataFrame, score, sink, checkpoint: str):
    """Scores sessions as they come to their end: score(transcripts of the batch's sessions, the batch) is written by
    sink(result, batch_id). assembled: assemble_sessions' rows; transcripts: a table, of which the rows of these sessions
    are read. A batch that is run again has the same id; batch_table() replaces its rows."""

    def step(batch: DataFrame, batch_id: int) -> None:
        ended = batch.select("session_id").distinct()
        sink(score(transcripts.join(ended, "session_id", "left_semi"), batch), batch_id)

    return assembled.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_table(path: str):
    """A sink for foreachBatch: each batch has a folder of its own under path, which a repeated batch overwrites as a whole.
    Read it by batch_rows()."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def batch_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


class Assembly(OneTimer):
    """The slots of a session that have come. A complete one is kept until the timer, so that documents that come again do
    not open it anew; an incomplete one is given out by the timer."""

    STATE = "slots string, complete boolean"

    def __init__(self, expected: int, wait_minutes: int) -> None:
        self.expected, self.wait = expected, wait_minutes * 60_000

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if any(t <= timerValues.getCurrentWatermarkInMs() for t in self.handle.listTimers()):
            yield from self.ended(key)  # rows of a batch come before its timers: what they meet has ended
        held, complete = self.held.get() if self.held.exists() else ("", False)
        own = pd.concat(list(rows))
        slots = (set(held.split("\x1f")) - {""}) | set(own["slot"].dropna())
        ready = not complete and len(slots) >= self.expected
        until = own["ts"].max().value // 1_000_000 + self.wait
        self.keep(("" if complete or ready else "\x1f".join(sorted(slots)), complete or ready), until, timerValues)
        if ready:
            yield pd.DataFrame([(int(key[0]), sorted(slots), True)], columns=["session_id", "slots", "complete"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self.ended(key)

    def ended(self, key: tuple) -> Iterator[pd.DataFrame]:
        held, complete = self.held.get()
        self.held.clear()
        if not complete:
            yield pd.DataFrame([(int(key[0]), sorted(set(held.split("\x1f")) - {""}), False)], columns=["session_id", "slots", "complete"])


def assemble_sessions(arrivals: DataFrame, expected: int, wait_minutes: int = 60) -> DataFrame:
    """session_id, slots, complete of a stream of documents (session_id, slot, ts with a watermark): a session once `expected`
    different slots have come, or incomplete once the watermark is wait_minutes past its latest one. State of either kind
    ends by then. What comes for a session after that begins a new one."""
    keep_state_in_rocksdb(arrivals.sparkSession)
    return arrivals.groupBy("session_id").transformWithStateInPandas(Assembly(expected, wait_minutes), ASSEMBLED, "append", "eventTime")


def sweep(stream: DataFrame, job, checkpoint: str):
    """Runs job(batch) over what has arrived since the last run and stops: an incremental sweep."""
    return stream.writeStream.foreachBatch(lambda batch, _: job(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def duplicates_dropped(requests: DataFrame, late: str = "24 hours") -> DataFrame:
    """First requests only, where replays and conflicts need no answer."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["tenant_id", "key"]).select("tenant_id", "key", "request_id", F.col("ts"))
