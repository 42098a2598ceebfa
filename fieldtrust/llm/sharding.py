"""Minimax contiguous partition of a table into shards.

Rows with equal texts form one atomic group. Groups are ordered by a hash of their text; a group larger than an even
share goes first and has a shard to itself. The smallest capacity that lets the remaining groups be cut into the
remaining shards is found by binary search with a greedy check. Of the cuts within that capacity those are then made whose
smallest shard is largest, as greedy cuts would leave the last shard short.

The search never sees all groups. It works on cells: ranges of the hash order with the sum of their sizes, at most
CELLS of them. A cell may be cut anywhere (optimistic) or nowhere (pessimistic); where the two answers differ, the
cells at the cuts are read again in finer ranges until both agree, which makes the answer exact.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtrust.llm.common import saved

#: Ranges of the hash order that the driver holds at first, and by which one range is split when read again.
CELL_BITS, FINER_BITS = 14, 6
#: Cells that are read again at once, the largest first: at most OPEN_CELLS << FINER_BITS rows come back.
OPEN_CELLS = 1024
#: Rows of one slice, within which slots are numbered, and rows from which a group is dealt over several.
SLICE_ROWS, HOT_ROWS = 200_000, 10_000
#: Slices, and large groups, that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: A cell at a cut is read again while it is larger than one in so many of an even share.
FINE = 1000


@dataclass
class Cells:
    low: np.ndarray  # first position of the cell in the order
    high: np.ndarray  # first position after it
    size: np.ndarray
    largest: np.ndarray
    groups: np.ndarray


def greedy(cells: Cells, capacity: int, whole: bool) -> list[tuple[int, int]] | None:
    """Cuts (cell, units of that cell before the cut) of the greedy filling; whole: no cell is divided. None if a cell
    does not fit."""
    ends = np.cumsum(cells.size)
    total, at, cuts = int(ends[-1]), 0, []
    while total - at > capacity:
        k = bisect_right(ends, at + capacity)
        divided = not whole and cells.groups[k] > 1
        here = at + capacity if divided else int(ends[k - 1]) if k else 0
        if here <= at:
            return None
        cuts.append((k, here - (int(ends[k - 1]) if k else 0)))
        at = here
    return cuts


def even(cells: Cells, shards: int, capacity: int) -> list[int]:
    """Cells before which the shards after the first begin: of all cuts between cells that keep every shard within the
    capacity, some whose smallest shard is as large as can be. There must be such cuts.

    For a least size, the ends that j shards can reach follow from those of j - 1 by one pass over the cells; the largest
    feasible least size is found by binary search. Then the cuts are taken from the end, each next to an even share of what
    comes before it."""
    ends = np.concatenate(([0], np.cumsum(cells.size)))
    total = int(ends[-1])

    def reached(least: int) -> list[np.ndarray] | None:
        low, high = np.searchsorted(ends, ends - capacity), np.searchsorted(ends, ends - least, side="right")
        found = [np.zeros(len(ends), bool)]
        found[0][0] = True
        for _ in range(shards):
            before = np.concatenate(([0], np.cumsum(found[-1])))
            found.append(before[np.maximum(high, low)] > before[low])
        return found if found[-1][-1] else None

    least, most = 0, total // shards
    while least < most:
        middle = (least + most + 1) // 2
        least, most = (middle, most) if reached(middle) else (least, middle - 1)
    found, cuts, end = reached(least), [], len(ends) - 1
    for j in range(shards - 1, 0, -1):
        fit = np.flatnonzero(found[j] & (ends >= ends[end] - capacity) & (ends <= ends[end] - least))
        end = int(fit[np.argmin(np.abs(ends[fit] - ends[end] * j / (j + 1)))])
        cuts.append(end)
    return cuts[::-1]


def smallest(cells: Cells, shards: int, whole: bool) -> int:
    total = int(cells.size.sum())
    low, high = max(-(-total // shards), int(cells.largest.max())), total
    while low < high:
        middle = (low + high) // 2
        cuts = greedy(cells, middle, whole)
        if cuts is not None and len(cuts) < shards:
            high = middle
        else:
            low = middle + 1
    return low


def refined(cells: Cells, at: set[int], groups: DataFrame) -> Cells:
    """The cells with those numbered in `at` read again in finer ranges."""
    spark = groups.sparkSession
    old = [(int(cells.low[i]), int(cells.high[i])) for i in sorted(at)]
    # every range lies in one of the first cells, whose number is the join key
    width = 1 << (40 - CELL_BITS)
    ranges = spark.createDataFrame([(a // width, a, b, max(1, -(-(b - a) // (1 << FINER_BITS)))) for a, b in old], "cell long, low long, high long, step long")
    finer = (
        groups.withColumn("cell", F.floor(F.col("pos") / width).cast("long"))
        .join(F.broadcast(ranges), "cell")
        .where("pos >= low and pos < high")
        .groupBy((F.col("low") + F.floor((F.col("pos") - F.col("low")) / F.col("step")) * F.col("step")).cast("long").alias("a"), "step", "high")
        .agg(F.sum("size").alias("size"), F.max("size").alias("largest"), F.count("*").alias("n"))
        .collect()
    )
    new = [(r.a, min(r.a + r.step, r.high), r["size"], r.largest, r.n) for r in finer]
    keep = [i for i in range(len(cells.size)) if i not in at]
    rows = sorted([*zip(*(x[keep].tolist() for x in (cells.low, cells.high, cells.size, cells.largest, cells.groups)), strict=True), *new])
    return Cells(*(np.array(x, np.int64) for x in zip(*rows, strict=True)))


def evened(cells: Cells, groups: DataFrame, shards: int, capacity: int) -> list[int]:
    """The positions of even cuts, with the cells at them read in finer ranges."""
    while True:
        cuts = [k for k in even(cells, shards, capacity) if k < len(cells.size)]
        large = {i for k in cuts for i in (k - 1, k) if i >= 0 and cells.groups[i] > 1 and cells.size[i] * shards * FINE > cells.size.sum()}
        if not large:
            return [int(cells.low[k]) for k in cuts]
        cells = refined(cells, large, groups)


def cut_positions(groups: DataFrame, shards: int) -> list[int]:
    """Positions before which the shards after the first begin. groups: pos (0 to 2**40 - 1), size."""
    width = 1 << (40 - CELL_BITS)
    first = groups.groupBy(F.floor(F.col("pos") / width).cast("long").alias("cell")).agg(F.sum("size").alias("size"), F.max("size").alias("largest"), F.count("*").alias("n")).collect()
    if not first:
        return []
    rows = sorted((r.cell * width, (r.cell + 1) * width, r["size"], r.largest, r.n) for r in first)
    cells = Cells(*(np.array(x, np.int64) for x in zip(*rows, strict=True)))
    for _ in range(60):
        least, most = smallest(cells, shards, False), smallest(cells, shards, True)
        if least == most:
            return evened(cells, groups, shards, least)
        open_cells: set[int] = set()
        for capacity in {least, most, (least + most) // 2}:
            for whole in (False, True):
                for k, _ in greedy(cells, capacity, whole) or []:
                    open_cells.update(x for x in (k - 1, k, k + 1) if 0 <= x < len(cells.size) and cells.groups[x] > 1)
        # the cuts of the pessimistic filling move ahead of the optimistic ones; what lies between is open as well
        for (a, _), (b, _) in zip(greedy(cells, least, False) or [], greedy(cells, most, True) or [], strict=False):
            open_cells.update(x for x in range(min(a, b), max(a, b) + 1) if cells.groups[x] > 1)
        if not open_cells:
            open_cells = {int(i) for i in np.argsort(-cells.groups)[:1024] if cells.groups[i] > 1}
        if not open_cells:
            return evened(cells, groups, shards, most)
        cells = refined(cells, set(sorted(open_cells, key=lambda i: -int(cells.size[i]))[:OPEN_CELLS]), groups)
    raise RuntimeError("the search for the capacity did not settle")


def shard_rows(docs: DataFrame, shards: int = 40, id_column: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null) of each row of docs.

    size is the UTF-8 length of the text plus `overhead`; a null text counts as empty and shares a group with empty
    texts. Equal texts stay together (and so do the rare ones whose hashes share 40 bits). Slots are gapless from 0 in
    each shard and follow the group order within slices of it, then the id (nulls first); groups of many rows come
    behind the others of their slice, dealt by a hash of the id. Equal rows get different slots. Extra columns are ignored; an empty table gives an empty one.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = saved(
        docs.select(
            F.col(id_column).alias("doc_id"),
            (F.octet_length(body) + overhead).cast("long").alias("size"),
            F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
            F.xxhash64(body).alias("group"),
        ),
        "sizes",
    )
    position = F.shiftrightunsigned("group", 24)
    groups = saved(rows.groupBy("group").agg(F.sum("size").alias("size"), F.count("*").alias("n")).withColumn("pos", position), "groups")
    # groups at one position are one atom
    total, big = groups.agg(F.sum("size")).first()[0] or 0, []
    for r in groups.groupBy("pos").agg(F.sum("size").alias("size")).orderBy(F.desc("size"), "pos").limit(shards).collect():
        if len(big) + 1 < shards and r["size"] * (shards - len(big)) > total:
            big.append(r.pos)
            total -= r["size"]
    atoms = groups.where(~F.col("pos").isin(big)) if big else groups
    cuts = cut_positions(atoms.groupBy("pos").agg(F.sum("size").alias("size")), shards - len(big)) if total else []
    shard = F.lit(len(big))
    for c in cuts:
        shard = shard + (F.col("pos") >= c).cast("int")
    for i, p in enumerate(big):
        shard = F.when(F.col("pos") == p, F.lit(i)).otherwise(shard)

    # slots: numbered within slices of bounded size, which are put one after another
    placed = rows.withColumn("pos", position).withColumn("shard", shard.cast("int"))
    n_rows = groups.agg(F.sum("n")).first()[0] or 0
    fine = max(1, min(1 << 20, n_rows // SLICE_ROWS * 4 + 256))
    hot = saved(groups.groupBy("pos").agg(F.sum("n").alias("n")).where(F.col("n") > HOT_ROWS).select("pos", F.ceil(F.col("n") / HOT_ROWS).alias("salts")), "hot")
    # rows without an id are told apart by where the written table holds them
    salt = F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id())), F.col("salts"))
    slice_of = placed.withColumn("slice", F.floor(F.col("pos") / (2**40 // fine)).cast("long")).join(_checked(hot), "pos", "left").withColumn("salt", F.coalesce(salt, F.lit(-1)))
    # a large group is a slice of its own between those of the rest
    slice_of = saved(slice_of.withColumn("first", F.when(F.col("salts").isNotNull(), F.col("pos")).otherwise(F.lit(-1))).drop("salts"), "slices")
    before = Window.partitionBy("shard").orderBy("slice", "first", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved(slice_of.groupBy("shard", "slice", "first", "salt").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "offsets")
    inside = Window.partitionBy("shard", "slice", "first", "salt").orderBy("pos", "group", "doc_id")
    numbered = slice_of.withColumn("k", F.row_number().over(inside) - 1)
    return numbered.join(_checked(offsets), ["shard", "slice", "first", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _checked(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
