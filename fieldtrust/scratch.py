"""Intermediate tables in the folder that all machines share (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir. Where it is unset, a temporary folder on a local
    master (tests) and an error on a cluster, whose machines do not share one (local-cluster masters count as such)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths written in each open passing(), the innermost last.
_passing: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


def saved(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage is cut and lost executors lose nothing. A lasting table
    outlives the innermost passing() around it and belongs to the next one."""
    spark, path, scopes = df.sparkSession, scratch_path(df.sparkSession, name), _passing.get()
    scopes = scopes[:-1] if lasting else scopes
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that saved() writes inside are deleted at the end. What is used afterwards must rest on lasting ones."""
    paths: list[str] = []
    token = _passing.set((*_passing.get(), paths))
    try:
        yield
    finally:
        _passing.reset(token)
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
