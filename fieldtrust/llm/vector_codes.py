"""Product-quantised vector codes with exact nearest-entry search by Orchard's method.

Vectors of integers floor(1024 x) are cut into equal consecutive parts; each part has a codebook of up to 256 entries,
trained by assignment and averaging over all rows. The nearest entry is found without comparing all entries: every entry
keeps the list of the others in the order of their distance to it. A search stands at an entry, walks that entry's list,
jumps to the list of an entry that turns out nearer, passes over what is marked as visited, and ends where the list goes
beyond twice the distance at hand: by the triangle inequality nothing nearer can follow. Distances are exact integers, and
the end is strict, so ties go to the lower index as in a full comparison.

Rows are never shuffled for training: each task adds up its rows' parts by entry (1,024 rows of sums a task), Spark adds
these, and the new codebooks (4 x 256 entries) are all that reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrust.llm.common import BROADCAST_ROWS, saved, small_batches

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Neighbours that a search looks at before it moves on, and rows that are searched together.
STEP, TOGETHER = 8, 4096
#: Rows of an Arrow batch.
BATCH = 4096


class Codebook(NamedTuple):
    """Entries of one part with their neighbour lists."""

    entries: np.ndarray  # k x d
    order: np.ndarray  # k x k: for each entry the others, nearest first (ties by index), itself in front
    apart: np.ndarray  # k x k: their squared distances

    @staticmethod
    def of(entries: np.ndarray) -> Codebook:
        apart = np.stack([((entries - e) ** 2).sum(axis=1) for e in entries])
        order = np.argsort(apart, axis=1, kind="stable")
        # an entry equal to one of lower index stands behind it; a search may stand at either
        return Codebook(entries, order, np.take_along_axis(apart, order, axis=1))


def nearest(book: Codebook, rows: np.ndarray, counted: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of each row, ties to the lower index."""
    k, n = len(book.entries), len(rows)
    # start at the entry with the nearest sum of components
    sums = book.entries.sum(axis=1)
    by_sum = np.argsort(sums, kind="stable")
    at = by_sum[np.minimum(np.searchsorted(sums[by_sum], rows.sum(axis=1)), k - 1)]
    best = ((rows - book.entries[at]) ** 2).sum(axis=1)
    seen = np.zeros((n, k), bool)
    seen[np.arange(n), at] = True
    place = np.zeros(n, np.int64)
    live = np.arange(n)
    while len(live):
        here = at[live]
        places = np.minimum(place[live, None] + np.arange(STEP), k - 1)
        other = book.order[here[:, None], places]
        beyond = book.apart[here[:, None], places] > 4 * best[live, None]
        fresh = ~beyond & ~seen[live[:, None], other]
        i, j = np.nonzero(fresh)
        if counted is not None:
            counted.append(len(i))
        seen[live[i], other[i, j]] = True
        far = ((rows[live[i]] - book.entries[other[i, j]]) ** 2).sum(axis=1)
        found = np.full(other.shape, np.iinfo(np.int64).max)
        found[i, j] = far
        low = found.min(axis=1)
        lowest = np.where(found == low[:, None], other, k).min(axis=1)
        better = (low < best[live]) | ((low == best[live]) & (lowest < here))
        moved = live[better]
        at[moved], best[moved], place[moved] = lowest[better], low[better], 0
        stay = ~better
        place[live[stay]] += STEP
        live = live[better | (~beyond[:, -1] & (place[live] < k))]
    return at, best


def largest(width: int) -> float:
    """Scaled components below this have exact distances in 64 bits over `width` of them, also four times as large."""
    return float(int((2**63 / (16 * width)) ** 0.5))


def whole_vectors(lists: pa.Array, dim: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(kept, values): which rows hold a vector of dim components, all finite and below largest(); these as integers."""
    sized = np.array(lists.is_valid()) & (lists.value_lengths().fill_null(-1).to_numpy() == dim)
    flat = lists.filter(pa.array(sized)).flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)).reshape(-1, dim)
    scaled = values * SCALE
    fit = (np.abs(scaled) < largest(dim // parts)).all(axis=1)  # false for NaN and infinity
    kept = np.zeros(len(lists), bool)
    kept[np.flatnonzero(sized)[fit]] = True
    return kept, np.floor(scaled[fit]).astype(np.int64)


def usable(vectors: DataFrame, parts: int) -> DataFrame:
    """The rows whose vector is not null and holds finite components only."""
    bound = F.sqrt(F.lit(2.0**63) * parts / (16 * F.size("embedding")))
    good = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double") * SCALE) < bound))  # NaN is above all
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(good)


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """Codebooks of the parts of the `entries` smallest vec_ids; of rows with one id the least vector counts. Only ids are
    shuffled; the vectors of the few that are wanted are looked up."""
    rows = usable(vectors, parts).where("vec_id is not null").select("vec_id", "embedding")
    ids = saved(rows.select("vec_id").distinct().orderBy("vec_id").limit(entries), "first")
    found = rows.join(F.broadcast(ids), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    first = found.orderBy("vec_id").select("embedding").toArrow().column(0).combine_chunks()  # `entries` rows at most
    if not len(first):
        return []
    dim = len(first[0])
    if dim % parts:
        raise ValueError(f"vectors of {dim} components cannot be cut into {parts} equal parts")
    _, values = whole_vectors(first, dim, parts)
    return np.split(values, parts, axis=1)


def sums_of(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """part, entry, n, sums: of the rows' parts that are nearest to each entry; one set of rows for each task, added up."""
    dim, width = sum(b.shape[1] for b in books), books[0].shape[1]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook.of(b) for b in books]
        n = np.zeros((len(own), len(books[0])), np.int64)
        sums = np.zeros((len(own), len(books[0]), width), np.int64)
        for batch in batches:
            _, values = whole_vectors(batch.column(0), dim, len(own))
            for a in range(0, len(values), TOGETHER):
                for p, book in enumerate(own):
                    rows = values[a : a + TOGETHER, p * width : (p + 1) * width]
                    code, _ = nearest(book, rows)
                    n[p] += np.bincount(code, minlength=len(book.entries))
                    np.add.at(sums[p], code, rows)
        part, entry = (x.astype(np.int32) for x in np.nonzero(n))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    each = vectors.select("embedding").mapInArrow(added, "part int, entry int, n long, sums array<long>")
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total)


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks after some rounds of assigning every row and replacing each entry by its rows' floor(sum / count)."""
    books = first_codebooks(vectors, parts, entries)
    for _ in range(rounds if books else 0):
        for r in sums_of(vectors, books).collect():  # parts x entries rows
            books[r.part][r.entry] = [int(s) // r.n for s in r[3:]]
    return books


def encoded(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code, error of each row with a whole vector."""
    dim, width = sum(b.shape[1] for b in books), books[0].shape[1]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook.of(b) for b in books]
        for batch in batches:
            kept, values = whole_vectors(batch.column(2), dim, len(own))
            codes, error = np.zeros((len(values), len(own)), np.uint8), np.zeros(len(values), np.int64)
            for a in range(0, len(values), TOGETHER):
                for p, book in enumerate(own):
                    codes[a : a + TOGETHER, p], far = nearest(book, values[a : a + TOGETHER, p * width : (p + 1) * width])
                    error[a : a + TOGETHER] += far
            keep = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, label {vectors.schema['label'].dataType.simpleString()}, code string, error long"
    return vectors.select("vec_id", "label", "embedding").mapInArrow(coded, schema)


def books_hash(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label, label_error, codebooks_sha256 of the rows of vectors (vec_id, embedding, label; other
    columns are ignored).

    Rows go whose vector is null or empty, has another length than that of the smallest vec_id, or a component that is
    null, not finite or so large that its distances would not fit a long (185,000 at 16 components a part). A null vec_id is encoded and
    trained on like any other but never starts a codebook; repeated rows all stay and all count. With fewer than `entries`
    ids the codebooks are as short. Vectors whose length cannot be cut into equal parts are refused. label_error adds up
    over equal labels, nulls together. An empty table gives an empty table.
    """
    small_batches(vectors.sparkSession, BATCH)
    books = trained(vectors, parts, entries, rounds)
    if not books:
        nothing = vectors.where(F.lit(False)).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), "label")
        return nothing.withColumns({"label_error": F.lit(0).cast("long"), "codebooks_sha256": F.lit("")})
    rows = saved(encoded(vectors, books), "codes")
    per_label = saved(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "labels")
    few = F.broadcast(per_label) if per_label.count() <= BROADCAST_ROWS else per_label
    joined = rows.join(few, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label", "label_error", F.lit(books_hash(books)).alias("codebooks_sha256"))
