"""Scans over ordered rows that need what came before, without gathering a key in one task.

Rows are range-partitioned by (keys, order), so that a key with many rows lies in many partitions, each in order. Each
partition does its share alone and hands over one small row; what the partitions before add up to comes back to it by a
broadcast of as many rows as there are partitions. Tables between the passes are written to the shared folder: both passes
see the same ranges, and nothing stays in memory.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from fieldtrust.scratch import saved


def in_ranges(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """df in as many ranges as the session has shuffle partitions, sorted in each; partition ids follow the order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    return df.repartitionByRange(n, *columns).sortWithinPartitions(*columns)


def _nullable(schema: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType) for f in schema.fields])


def running_sums(df: DataFrame, order: list[Column | str], sums: dict[str, str | None]) -> DataFrame:
    """df with the sums (out: column; None counts rows) of long columns over all rows up to and with each one. order must
    be total. A null adds nothing."""
    added = StructType.fromDDL(", ".join(f"`{o}` long" for o in sums) + ", _part int")
    schema = StructType([*_nullable(df.schema).fields, *added.fields])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carry = TaskContext.get().partitionId(), dict.fromkeys(sums, 0)
        for batch in batches:
            columns = list(batch.columns)
            for out, c in sums.items():
                value = np.ones(len(batch), np.int64) if c is None else batch.column(c).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
                total = np.cumsum(value) + carry[out]
                carry[out] = int(total[-1]) if len(total) else carry[out]
                columns.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(batch), pa.int32())], names=schema.names)

    local = saved(in_ranges(df, order).mapInArrow(add, schema), "running")
    whole = [F.sum(F.lit(1) if c is None else F.col(c).cast("long")).alias(o) for o, c in sums.items()]
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    offsets = local.groupBy("_part").agg(*whole).select("_part", *[F.coalesce(F.sum(o).over(before), F.lit(0)).alias(f"_{o}") for o in sums])
    joined = local.join(F.broadcast(offsets), "_part")
    return joined.select(*df.columns, *[(F.col(o) + F.col(f"_{o}")).alias(o) for o in sums])


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """df with the values that columns (out: column) have in the row before within the same keys; null in a key's first
    row. order must be total within a key. Null keys are keys of their own."""
    kept = _nullable(df.schema).fields
    added = [StructType.fromDDL(f"`{o}` {df.schema[c].dataType.simpleString()}").fields[0] for o, c in columns.items()]
    schema = StructType([*kept, *added, *StructType.fromDDL("_part int, _first boolean, _last boolean").fields])
    arrow = to_arrow_schema(schema)

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tail = TaskContext.get().partitionId(), None
        held: list[pa.Array] | None = None

        def done(arrays: list[pa.Array], last: bool) -> pa.RecordBatch:
            marks = np.zeros(len(arrays[0]), bool)
            marks[-1] = last
            return pa.RecordBatch.from_arrays([*arrays, pa.array(marks)], schema=arrow)

        for batch in batches:
            if not len(batch):
                continue
            if held is not None:
                yield done(held, False)
            own = pa.Table.from_batches([batch])
            before = pa.concat_tables([own.slice(0, 1) if tail is None else tail, own.slice(0, len(own) - 1)]).combine_chunks()
            same = np.ones(len(own), bool)
            for k in keys:
                a, b = own.column(k), before.column(k)
                equal = pc.fill_null(pc.equal(a, b), False).to_numpy()
                same &= equal | (pc.is_null(a).to_numpy() & pc.is_null(b).to_numpy())
            first = np.zeros(len(own), bool)
            if tail is None:
                same[0], first[0] = False, True
            values = [pc.if_else(pa.array(same), before.column(c), pa.scalar(None, before.column(c).type)).combine_chunks() for c in columns.values()]
            values = [v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for v in values]
            held = [*batch.columns, *values, pa.array([part] * len(own), pa.int32()), pa.array(first)]
            tail = own.slice(len(own) - 1, 1)
        if held is not None:
            yield done(held, True)

    local = saved(in_ranges(df, [*keys, *order]).mapInArrow(shifted, schema), "shifted")
    ends = local.where("_last").select("_part", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns.values())])
    names = ends.columns[1:]
    by_part = Window.orderBy("_part")  # one row for each partition
    handed = ends.select("_part", *[F.lag(n).over(by_part).alias(n) for n in names], (F.row_number().over(by_part) > 1).alias("_handed"))
    joined = local.join(F.broadcast(handed), "_part")
    goes_on = F.col("_first") & F.col("_handed")
    for i, k in enumerate(keys):
        goes_on &= F.col(f"_k{i}").eqNullSafe(F.col(k))
    return joined.select(*df.columns, *[F.when(goes_on, F.col(f"_v{i}")).otherwise(F.col(o)).alias(o) for i, o in enumerate(columns)])


class Fold(NamedTuple):
    """A state that goes from row to row of a key. start: the state before a key's first row; step: (state, row) to (state,
    values); segment: an object that takes the rows of a stretch of one key (add) and tells the state after it from the
    state before (through), or None where only the rows can tell."""

    start: Callable[[dict], Any]
    step: Callable[[Any, dict], tuple[Any, tuple]]
    segment: Callable[[], Any]


class Summary(NamedTuple):
    """What a partition hands over: its first and last key, the stretch of the first one if it has no other, the state before
    its first row if a key begins there, and the state after its last row if its last key began within it."""

    head: tuple
    last: tuple
    segment: Any
    start: Any
    end: Any


def folded(rows: DataFrame, keys: list[str], order: list[str], schema: str, fold: Fold) -> DataFrame:
    """keys and the values that fold.step returns for each row, in the order given within its key (nulls last).

    First pass: each range partition folds the keys that begin in it, and sums up the stretch of the key that it begins
    with. These summaries, one for each partition, are composed to the state with which each partition begins; where one
    cannot tell, the stretch is run through once, for all such keys together. Second pass: the open stretches are folded
    from those states, each in a task of its own."""
    spark, values = rows.sparkSession, StructType.fromDDL(schema)
    kinds = _nullable(rows.select(*keys).schema)
    out = StructType([*kinds.fields, *values.fields])
    full = StructType([*out.fields, *StructType.fromDDL("_part int, _summary binary").fields]).add("_row", _nullable(rows.schema))
    types, arrow = to_arrow_schema(values), to_arrow_schema(full)
    by = [F.asc_nulls_last(c) for c in (*keys, *order)]

    def table(batch: pa.RecordBatch | None, found: list[tuple | None], **more: list) -> pa.RecordBatch:
        n = len(found)
        made = list(zip(*[v or (None,) * len(types) for v in found], strict=True)) if n else [()] * len(types)
        columns = [*([batch.column(k) for k in keys] if batch is not None else [pa.nulls(n, arrow.field(k).type) for k in keys]), *(pa.array(c, f.type) for c, f in zip(made, types, strict=True))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(more[f.name], f.type) for f in arrow if f.name in more)], names=[*out.names, *(f.name for f in arrow if f.name in more)])

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, current, state, start, alone = TaskContext.get().partitionId(), None, None, None, None, True
        segment = fold.segment()
        for batch in batches:
            found, open_rows = [], []
            for r in batch.to_pylist():
                key = tuple(r[k] for k in keys)
                if head is None:
                    head, current, start = key, key, fold.start(r)
                elif key != current:
                    current, state, alone = key, fold.start(r), False
                if alone:
                    segment.add(r)
                    found.append(None)
                    open_rows.append(r)
                else:
                    state, value = fold.step(state, r)
                    found.append(value)
                    open_rows.append(None)
            yield table(batch, found, _part=[part] * len(found), _summary=[None] * len(found), _row=open_rows)
        if head is not None:
            yield table(None, [None], _part=[part], _summary=[pickle.dumps(Summary(head, current, segment if alone else None, start, state))], _row=[None])

    local = saved(in_ranges(rows, by).mapInArrow(first_pass, full), "folded")
    summaries = {r["_part"]: pickle.loads(r["_summary"]) for r in local.where("_summary is not null").select("_part", "_summary").collect()}  # noqa: S301
    open_rows = local.where("_row is not null").select("_part", "_row.*")

    def replay(begin: dict[int, Any], ends_only: bool) -> Callable:
        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, state = None, None
            for batch in batches:
                found, ended = [], []
                for part, r in zip(batch.column("_part").to_pylist(), batch.drop_columns(["_part"]).to_pylist(), strict=True):
                    if part != current:
                        if ends_only and current is not None:
                            ended.append((current, pickle.dumps(state)))
                        current, state = part, begin[part]
                    state, value = fold.step(state, r)
                    found.append(value)
                if ends_only:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in ended], pa.int32()), pa.array([x for _, x in ended], pa.binary())], names=["part", "state"])
                else:
                    yield table(batch, found)
            if ends_only and current is not None:
                yield pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([pickle.dumps(state)], pa.binary())], names=["part", "state"])

        return again

    placed = lambda df: df.repartition("_part").sortWithinPartitions("_part", *[F.asc_nulls_last(c) for c in order])

    def ended(asked: dict[int, Any]) -> dict[int, Any]:
        """The states after the open stretches of some partitions, run through from the states given."""
        found = placed(open_rows.where(F.col("_part").isin(list(asked)))).mapInArrow(replay(asked, True), "part int, state binary")
        return {r.part: pickle.loads(r.state) for r in found.collect()}  # noqa: S301

    begin = composed(summaries, ended)
    replayed = placed(open_rows).mapInArrow(replay(begin, False), out)
    return local.where("_row is null and _summary is null").select(out.names).unionByName(replayed)


def composed(summaries: dict[int, Summary], ended: Callable[[dict[int, Any]], dict[int, Any]]) -> dict[int, Any]:
    """The state with which each partition begins. Keys that lie in several partitions are followed side by side: each round
    asks at once for all stretches that could not tell (ended)."""
    chains: list[tuple[list[int], Any]] = []  # the partitions that begin with a key, and the state before the first of them
    before = None
    for part in sorted(summaries):
        s = summaries[part]
        if before is None or s.head != before.last:
            chains.append(([], s.start))
        chains[-1][0].append(part)
        if s.segment is None:
            chains.append(([], s.end))
        before = s
    begin: dict[int, Any] = {}
    states, at = [state for _, state in chains], [0] * len(chains)
    while True:
        asked: dict[int, int] = {}
        for i, (parts, _) in enumerate(chains):
            while at[i] < len(parts):
                part = parts[at[i]]
                begin[part] = states[i]
                after = summaries[part].segment.through(states[i]) if at[i] + 1 < len(parts) else states[i]
                if after is None:
                    asked[part] = i
                    break
                states[i], at[i] = after, at[i] + 1
        if not asked:
            return begin
        for part, state in ended({p: states[i] for p, i in asked.items()}).items():
            states[asked[part]] = state
            at[asked[part]] += 1
