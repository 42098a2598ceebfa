"""Helpers that the corpus operators share: scratch tables, checked broadcasts, bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.scratch import passing, saved, scratch_path, scratch_root

__all__ = ["BATCH_ROWS", "BROADCAST_ROWS", "byte_groups", "documents", "drop_ids", "hash_sample", "keep_ids", "passing", "saved", "scratch_path", "scratch_root", "small_batches"]

#: A key set of at most this many rows (16 bytes a row) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows of an Arrow batch handed to Python; texts can be long.
BATCH_ROWS = 512


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of at most `rows` rows from now on; smaller ones of the session stay. It holds for the session, as
    plans read it when they run. Spark bounds the bytes of a batch (spark.sql.execution.arrow.maxBytesPerBatch), so that
    long texts come in batches of few rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def keep_ids(df: DataFrame, ids: DataFrame, on: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose key is in ids (a saved table). Broadcast behind a count, shuffled beyond it."""
    return df.join(F.broadcast(ids) if ids.count() <= limit else ids, on, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, on: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose key is not in ids (a saved table); the counterpart of keep_ids."""
    return df.join(F.broadcast(ids) if ids.count() <= limit else ids, on, "left_anti").select(df.columns)


def hash_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows with different keys, in the order of a hash of the key: a fixed sample, however the table lies.
    A cut of the hash leaves about 1.5 times as many before the ordering, so no task sends `most` rows of its own."""
    order = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    n = rows.agg(F.approx_count_distinct(key)).first()[0]
    if n > 2 * most:
        rows = rows.where(order < int(1.5 * most / n * (1 << 30)))
    return rows.dropDuplicates([key]).orderBy(order, key).limit(most)


def byte_groups(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of consecutive items of at most `most` bytes together (one item may be larger)."""
    first = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(first, i)
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield slice(first, len(sizes))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
