"""Near-duplicate groups by MinHash, banding, exact verification and connected components.

1. Each text becomes a set of word shingles. Universal hash functions a*x + b give its minima; bands of `rows` minima
   give its bucket keys. With the defaults a pair at the threshold 0.85 is missed by all bands with probability 6e-9
   (0.8: 1e-5 at 40 bands, hence `bands` rises for lower thresholds, see `bands_for`).
2. Texts with the same set are one class, represented by its smallest id; only representatives go on.
3. Buckets give pairs with hubs, which are verified on full sets, and then blocks of bounded size for what hubs leave
   open (see buckets.py): there minima are compared first, full sets where they allow a link. Nothing is capped.
4. Components come from alternating large-star and small-star steps, each written to the shared folder.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrust.llm.buckets import block_rows, dealt, joined
from fieldtrust.llm.common import byte_groups, keep_ids, passing, saved, small_batches
from fieldtrust.llm.shingles import mixed, shingle_sets

ROWS = 6
#: Further members of a bucket's main component with which its other members are compared before the blocks.
MORE_HUBS = 2
#: Texts are hashed in groups of at most so many bytes.
GROUP_BYTES = 1 << 20


def bands_for(threshold: float, rows: int = ROWS, missed: float = 1e-8) -> int:
    """Bands that leave a pair at the threshold without a common bucket with probability `missed` at most."""
    return math.ceil(math.log(missed) / math.log1p(-(threshold**rows)))


def _hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """A row of n minima (their upper 32 bits) for each set; no set may be empty."""
    a, b = _hash_functions(n)
    out = np.empty((len(sets), n), np.uint32)
    sizes = [8 * len(s) for s in sets]
    for part in byte_groups(sizes, 1 << 17):
        own = sets[part]
        x, first = np.concatenate(own), np.cumsum([0, *map(len, own[:-1])])
        for k in range(n):
            out[part, k] = np.minimum.reduceat(x * a[k] + b[k], first) >> np.uint64(32)
    return out


def band_keys(rows: np.ndarray, per_band: int) -> np.ndarray:
    parts = rows.reshape(len(rows), -1, per_band).astype(np.uint64)
    keys = np.zeros(parts.shape[:2], np.uint64)
    for k in range(per_band):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k] + np.uint64(1))
    return mixed(keys + np.arange(parts.shape[1], dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).view(np.int64)


SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<long>, minima binary"


def signatures(docs: DataFrame, width: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, set_key, bands and the low bytes of the minima; the last three are null for empty sets."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            for part in byte_groups([len(t) + 1 for t in texts], GROUP_BYTES):
                sets = list(shingle_sets(texts[part], width))
                full = [i for i, s in enumerate(sets) if len(s)]
                rows = minima([sets[i] for i in full], bands * ROWS) if full else np.zeros((0, bands * ROWS), np.uint32)
                keys = band_keys(rows, ROWS) if full else np.zeros((0, bands), np.int64)
                low = rows.astype(np.uint8)
                place = {i: k for k, i in enumerate(full)}
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[part.start : part.stop],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([keys[place[i]] if i in place else None for i in range(len(sets))], pa.list_(pa.int64())),
                        pa.array([low[place[i]].tobytes() if i in place else None for i in range(len(sets))], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "bands", "minima"],
                )

    return docs.select("doc_id", "text").mapInArrow(signed, SIGNED)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """node, shingles: the sorted distinct shingle hashes of each text."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            for part in byte_groups([len(t) + 1 for t in texts], GROUP_BYTES):
                sets = [s.view(np.int64) for s in shingle_sets(texts[part], width)]
                yield pa.RecordBatch.from_arrays([ids[part.start : part.stop], pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(listed, "node long, shingles array<long>")


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs a, b whose full sets satisfy 100 * intersection >= percent * union."""
    with passing(docs.sparkSession):
        pairs = saved(pairs, "pairs")
        nodes = saved(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "nodes")
        sets = saved(full_sets(keep_ids(docs.select("doc_id", "text"), nodes, "doc_id"), width).dropDuplicates(["node"]), "sets")
        left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
        both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb")).cast("long")
        counted = both.select("a", "b", common.alias("common"), F.size("sa").alias("na"), F.size("sb").alias("nb"))
        return saved(counted.where(f"100 * common >= {percent} * (na + nb - common)").select("a", "b"), "links", lasting=True)


class Side:
    """Some rows of a block as arrays, each node once."""

    def __init__(self, rows: dict[str, np.ndarray], at: np.ndarray):
        _, first = np.unique(rows["node"][at], return_index=True)
        at = at[first]
        self.node, self.component, self.size, self.sets = (rows[c][at] for c in ("node", "component", "size", "shingles"))
        self.minima = np.frombuffer(b"".join(rows["minima"][at]), np.uint8).reshape(len(at), -1) if len(at) else np.zeros((0, 1), np.uint8)


def block_links(left: Side, right: Side, percent: int) -> list[tuple[int, int]]:
    """Links between the rows of two sides (of a side among themselves if both are one), one for each pair of components
    that meets here."""
    alone = left is right
    if not len(left.node) or not len(right.node):
        return []
    names, place = np.unique(np.concatenate([left.component, right.component]), return_inverse=True)
    own = np.arange(len(names))  # the component that each one has been joined to within this block
    pl, pr = place[: len(left.node)], place[len(left.node) :]
    # of m minima fewer agree, for a pair that is linked, with a chance below 1e-9
    m, p = left.minima.shape[1], percent / 100
    least = math.floor(m * p - 6.5 * math.sqrt(m * p * (1 - p)))
    links = []
    for k, n in enumerate(left.size):
        fit = (100 * np.minimum(right.size, n) >= percent * np.maximum(right.size, n)) & (own[pr] != own[pl[k]])
        if alone:
            fit[: k + 1] = False
        at = np.flatnonzero(fit)
        if not len(at):
            continue
        agree = (right.minima[at] == left.minima[k]).sum(axis=1)
        near = agree >= least
        for j in at[near][np.argsort(-agree[near], kind="stable")]:
            if own[pr[j]] == own[pl[k]]:
                continue
            common = len(np.intersect1d(left.sets[k], right.sets[j], assume_unique=True))
            if 100 * common >= percent * (n + right.size[j] - common):
                links.append((int(max(left.node[k], right.node[j])), int(min(left.node[k], right.node[j]))))
                own[own == own[pr[j]]] = own[pl[k]]
    return links


def dealt_links(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of the blocks that were dealt together, one block (key, i, j) after another."""
    pdf = pdf.sort_values(["key", "i", "j"], kind="stable")
    rows = {c: pdf[c].to_numpy() for c in ("side", "node", "component", "size", "shingles", "minima", "alone")}
    keys = pdf[["key", "i", "j"]].to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
    links = []
    for a, b in zip(starts, np.append(starts[1:], len(pdf)), strict=True):
        at = np.arange(a, b)
        left = Side(rows, at[rows["side"][a:b] == 0])
        links += block_links(left, left if rows["alone"][a] else Side(rows, at[rows["side"][a:b] == 1]), percent)
    return pd.DataFrame(sorted(set(links)), columns=["a", "b"], dtype="int64")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (columns doc_id, text; others are ignored).

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer than `width` words is one shingle; a
    text without words, or null, has none, is linked with nothing and kept. Rows of one doc_id count as one document;
    equal rows stay repeated. A null doc_id has no component (null) and is kept. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    bands = max(40, bands_for(percent / 100))
    base = saved(signatures(docs, width, bands), "signatures")
    named = base.where("doc_id is not null and set_key is not null")
    classes = saved(named.groupBy("set_key").agg(F.min("doc_id").alias("node")), "classes")
    nodes = named.select("doc_id", "set_key", "n_shingles", "bands").join(classes.select(F.col("node").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi").dropDuplicates(["doc_id", "set_key"])
    keys = saved(nodes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("size"), F.explode("bands").alias("key")), "keys")

    def in_blocks(split: DataFrame) -> DataFrame:
        open_nodes = saved(split.select(F.col("node").alias("doc_id")).distinct(), "open")
        sets = full_sets(keep_ids(docs.select("doc_id", "text"), open_nodes, "doc_id"), width).dropDuplicates(["node"])
        low = named.select(F.col("doc_id").alias("node"), "minima").join(open_nodes.withColumnRenamed("doc_id", "node"), "node", "left_semi").dropDuplicates(["node"])
        rows = dealt(block_rows(split)).join(saved(sets.join(low, "node"), "known"), "node")
        return rows.groupBy("dealt").applyInPandas(lambda pdf: dealt_links(pdf, percent), "a long, b long").distinct()

    linked = joined(keys, percent, lambda pairs: verified(pairs, docs, width, percent), in_blocks, MORE_HUBS)
    grouped = saved(classes.join(linked, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id")), "grouped")
    out = base.select("doc_id", "n_shingles", "set_key").join(grouped, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
