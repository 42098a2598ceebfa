"""A corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it to the shared folder and reads it again
as the next stage's docs. All stages but the last return the columns that docs has, whatever their names.

Stages decide by row: a null doc_id, or one doc_id for several rows, changes nothing but what packing reports. Null, empty and
blank texts fail the quality rules. A null language or source is a group of its own. Exact ties between near copies go to
the smallest doc_id, and among equal ones to the row that stands first. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtrust.llm.common import BROADCAST_ROWS, drop_ids, keep_ids, passing, saved
from fieldtrust.llm.decontaminate import contamination
from fieldtrust.llm.line_templates import without_recurring_lines
from fieldtrust.llm.minhash_dedup import near_duplicates
from fieldtrust.llm.packing import pack
from fieldtrust.llm.quality_rules import judged
from fieldtrust.llm.queries import tokenizer_file


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def numbered(files: DataFrame) -> DataFrame:
    """files with no: 1, 2, ... Each partition of the written table counts its own; the counts of those before it are added."""
    written = saved(files.withColumn("part", F.spark_partition_id()), "files")
    own = written.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("file")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    offsets = written.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return saved(own.join(F.broadcast(offsets), "part").select("file", (F.col("first") + F.col("k")).alias("no")), "files")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (a number of its own for each row), text, lang, source and given, a struct of the other columns and the given
    doc_id: no name of docs can clash with one that a stage uses. Rows of files are numbered by file and place, which stay
    the same however often they are read; other rows are written once with their numbers."""
    rest = F.struct(*[F.col(quoted(c)) for c in docs.columns if c != "text"]).alias("given")
    named = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("text", "lang", "source")]
    try:
        placed = docs.select(rest, *named, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # these are no rows of files
        return saved(docs.select(rest, *named).withColumn("doc_id", F.monotonically_increasing_id()), "keyed")
    files = numbered(placed.select("file").distinct())
    joined = placed.join(F.broadcast(files) if files.count() <= BROADCAST_ROWS else files, "file")
    return joined.select("given", "text", "lang", "source", (F.col("no") * (1 << 40) + F.col("row")).alias("doc_id"))


def given(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of the stage's input docs from rows of keyed()."""
    return rows.select(*[F.col("text") if c == "text" else F.col("given")[c].alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far outside their language's and source's statistics go."""
    rows = keyed(docs)
    with passing(spark):
        rejected = saved(judged(rows).where(~F.col("kept")).select("doc_id"), "rejected", lasting=True)
    return given(drop_ids(rows, rejected, "doc_id"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; so do documents of which nothing is left. n_chars follows the text."""
    out = without_recurring_lines(keyed(docs)).where(~F.col("emptied"))
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("given.n_chars"))
        out = out.withColumn("given", F.col("given").withField("n_chars", length))
    return given(out, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, similarity 0.8) stays: one with the smallest id, if any has one."""
    rows = keyed(docs)
    with passing(spark):
        found = saved(near_duplicates(rows).select("doc_id", "component_id"), "components")
        groups = saved(found.groupBy("component_id").count().where("count > 1").select("component_id"), "groups")
        members = saved(rows.select("doc_id", F.col("given.doc_id").alias("id")).join(keep_ids(found, groups, "component_id"), "doc_id"), "members")
        first = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")).alias("first")).select(F.col("first.doc_id").alias("doc_id"))
        copies = saved(drop_ids(members.select("doc_id"), saved(first, "first"), "doc_id"), "copies", lasting=True)
    return given(drop_ids(rows, copies, "doc_id"), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    rows = keyed(docs)
    with passing(spark):
        found = contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
        hit = saved(found.where("contaminated").select("doc_id"), "contaminated", lasting=True)
    return given(drop_ids(rows, hit, "doc_id"), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as pieces of token sequences."""
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontaminate), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
