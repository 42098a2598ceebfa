"""Near-duplicate groups by SimHash: all fingerprints within a radius, found by tiled exact comparison.

1. Each text becomes a 64-bit fingerprint: bit i is set if it is set in over half of the XXH64 hashes of its word shingles.
2. Texts of one fingerprint are one class, represented by its smallest id; only classes go on.
3. The fingerprint's halves have population counts (hi, lo), 33 x 33 of them. Classes of equal counts make up tiles of at
   most about `tile` fingerprints. Two fingerprints differ in at least |hi - hi'| + |lo - lo'| bits, so tile pairs beyond
   the radius are never made. Each other pair of tiles is one group of two rows, compared with numpy in blocks by
   exclusive-or and bit counts: nothing is hashed to buckets and nothing can be missed.
4. A tile pair gives one link for each two components that it joins, never all pairs of a group of copies. Components come
   from large-star and small-star steps.

The comparison is exact and so quadratic in the number of different fingerprints: about 0.15 n^2 pairs of 8 bytes, in
tasks of at most tile^2 pairs each. A text copied any number of times counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrust.llm.buckets import components
from fieldtrust.llm.common import saved, small_batches

SEED = 42
RADIUS = 4
WIDTH = 4
#: Fingerprints of a tile, about; 16 bytes each.
TILE = 8192
#: Shingles whose hashes are counted at once, and pairs of a tile pair that are compared at once.
SHINGLES, TOGETHER = 1 << 16, 1 << 17

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The unsigned 64-bit fingerprint of a text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # runs of no ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = list(zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True))
    set_in = np.zeros(64, np.int64)
    for k in range(0, len(spans), SHINGLES):
        hashes = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in spans[k : k + SHINGLES]], "<u8")
        set_in += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of each row."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), width) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(marked, "doc_id long, fp long")


def halves() -> tuple:
    """Columns with the population counts of the upper and the lower 32 bits of fp."""
    return F.bit_count(F.shiftrightunsigned("fp", 32)).alias("hi"), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo")


def tile_links(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray] | None, radius: int) -> list[tuple[int, int]]:
    """Links (nodes a, b) between two tiles (fingerprints, nodes), or within one if right is None: one for each two
    components that are joined."""
    fps, nodes = left if right is None else tuple(np.concatenate(x) for x in zip(left, right, strict=True))
    of, first = (left[0], 0) if right is None else (right[0], len(left[0]))
    own = np.arange(len(fps))
    links = []
    step = max(1, TOGETHER // len(of))
    for k in range(0, len(left[0]), step):
        near = np.bitwise_count(left[0][k : k + step, None] ^ of[None, :]) <= radius
        a, b = np.nonzero(near)
        a, b = a + k, b + first
        open_ones = own[a] != own[b]
        if not open_ones.any():
            continue
        a, b = a[open_ones], b[open_ones]
        names = np.stack([np.minimum(own[a], own[b]), np.maximum(own[a], own[b])], axis=1)
        _, at = np.unique(names, axis=0, return_index=True)
        root: dict[int, int] = {}

        def top(x: int, root: dict[int, int] = root) -> int:
            while x in root:
                x = root[x]
            return x

        for i in at:
            x, y = top(int(own[a[i]])), top(int(own[b[i]]))
            if x != y:
                root[max(x, y)] = min(x, y)
                links.append((int(nodes[a[i]]), int(nodes[b[i]])))
        named = np.arange(len(own))
        for x in root:
            named[x] = top(x)
        own = named[own]
    return links


def tiled_links(classes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b: links between different fingerprints (node, fp; fp unique) that join all components within the radius."""
    counted = classes.select("node", "fp", *halves())
    sizes = {(r.hi, r.lo): r.n for r in counted.groupBy("hi", "lo").agg(F.count("*").alias("n")).collect()}  # 33 x 33 at most
    tiles = {c: -(-n // tile) for c, n in sizes.items()}
    firsts, total = {}, 0
    for c in sorted(tiles):
        firsts[c], total = total, total + tiles[c]
    if not total:
        return classes.sparkSession.createDataFrame([], "a long, b long")
    place = classes.sparkSession.createDataFrame([(*c, firsts[c], tiles[c]) for c in sorted(tiles)], "hi int, lo int, first int, k int")
    dealt = counted.join(F.broadcast(place), ["hi", "lo"]).withColumn("tile", F.col("first") + F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    spans = sorted((*c, firsts[c], tiles[c]) for c in tiles)

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        hi, lo = table.column("hi")[0].as_py(), table.column("lo")[0].as_py()
        body = np.stack([table.column("fp").to_numpy(), table.column("node").to_numpy()]).tobytes()
        own = key[0].as_py()
        others = [t for h, w, f, k in spans if abs(h - hi) + abs(w - lo) <= radius for t in range(f, f + k)]
        return pa.table({"i": pa.array([min(own, t) for t in others], pa.int32()), "j": pa.array([max(own, t) for t in others], pa.int32()), "body": pa.array([body] * len(others), pa.binary())})

    def opened(body: bytes) -> tuple[np.ndarray, np.ndarray]:
        fps, nodes = np.frombuffer(body, np.int64).reshape(2, -1)
        return fps.view(np.uint64), nodes

    def compared(key: tuple, table: pa.Table) -> pa.Table:
        sides = [opened(x) for x in table.column("body").to_pylist()]
        links = tile_links(sides[0], sides[1] if len(sides) == 2 else None, radius)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    pairs = dealt.select("tile", "hi", "lo", "fp", "node").groupBy("tile").applyInArrow(packed, "i int, j int, body binary")
    return pairs.groupBy("i", "j").applyInArrow(compared, "a long, b long")


def simhash_groups(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) for each row of docs (columns
    doc_id, text; others are ignored).

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer than `width` words is one shingle; null,
    empty and blank texts have fingerprint zero and are linked like any other. Repeated rows stay; rows of one doc_id with
    different texts are one node with several fingerprints, and tie their groups together. A row with a null doc_id has a
    fingerprint, no component (null), and links nothing. Texts of any length are hashed in pieces. An empty table gives an
    empty table.
    """
    small_batches(docs.sparkSession)
    base = saved(fingerprints(docs, width), "fingerprints")
    named = base.where("doc_id is not null")
    classes = saved(named.groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    spans = named.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("doc_id")
    tied = named.join(spans, "doc_id").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    linked = components(saved(tiled_links(classes, radius, tile).union(tied), "links"))
    grouped = saved(classes.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("component")), "grouped")
    out = base.join(grouped, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
