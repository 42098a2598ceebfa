"""Quality classifier: a factorisation machine on hashed words, structure statistics and text lengths.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum is taken in linear time as half of
(sum v_i x_i)^2 - sum (v_i x_i)^2 for each factor. It is fitted to a bounded sample of labelled rows and then scores
every whole text where it is read. Labels, language, source and ids are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrust.llm.common import byte_groups, hash_sample, small_batches
from fieldtrust.llm.quality_rules import P, statistics
from fieldtrust.llm.shingles import word_hashes

#: Hash buckets of words, structure statistics after them, factors.
BUCKETS, DENSE, FACTORS = 1 << 12, P + 3, 8
GROUP_BYTES = 1 << 20


@dataclass
class Rows:
    """Sparse rows: word buckets and their weights one after another, where each row's begin, and the statistics."""

    index: np.ndarray
    value: np.ndarray
    first: np.ndarray
    dense: np.ndarray

    def part(self, a: int, b: int) -> Rows:
        ends = np.append(self.first, len(self.index))
        return Rows(self.index[ends[a] : ends[b]], self.value[ends[a] : ends[b]], ends[a:b] - ends[a], self.dense[a:b])


def features(texts: list[str]) -> Rows:
    """Square roots of word counts by bucket, of length one for each text; every text has bucket 0 as a last resort."""
    found = [statistics(t) for t in texts]
    dense = np.array([[*f[5:], np.log1p(f[0]), np.log1p(f[1]), f[4] / max(1, f[0])] for f in found], float).reshape(len(texts), DENSE)
    hashes, bounds = word_hashes([t.encode("utf-8", "surrogatepass") for t in texts])
    buckets = (hashes >> np.uint64(20)).astype(np.int64) % (BUCKETS - 1) + 1
    index, value, sizes = [], [], []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own, n = np.unique(buckets[a:b], return_counts=True) if b > a else (np.zeros(1, np.int64), np.ones(1))
        index.append(own)
        value.append(np.sqrt(n) / np.sqrt(n.sum()))
        sizes.append(len(own))
    if not index:
        return Rows(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), dense)
    return Rows(np.concatenate(index), np.concatenate(value), np.cumsum(sizes) - sizes, dense)


@dataclass
class Machine:
    """Weights of words (w, v) and of standardised statistics (u, s), all within one factorisation machine."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    u: np.ndarray
    s: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def standard(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) / self.spread, -6, 6)

    def sums(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linear part, factor sums and sums of squares of each row."""
        x, d = rows.value, self.standard(rows.dense)
        xv = self.v[rows.index] * x[:, None]
        linear = np.add.reduceat(self.w[rows.index] * x, rows.first) + d @ self.u
        factor = np.add.reduceat(xv, rows.first) + d @ self.s
        squares = np.add.reduceat(xv * xv, rows.first) + (d * d) @ (self.s * self.s)
        return linear, factor, squares

    def score(self, rows: Rows) -> np.ndarray:
        if not len(rows.dense):
            return np.zeros(0)
        linear, factor, squares = self.sums(rows)
        margin = self.bias + linear + 0.5 * (factor**2 - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def fit(rows: Rows, labels: np.ndarray, epochs: int = 25, batch: int = 128, rate: float = 0.02, decay: float = 1e-4) -> Machine:
    """Adam on the logistic loss, both labels of equal weight. With one label only the bias is set."""
    rng = np.random.default_rng(5)
    spread = rows.dense.std(axis=0) + 1e-3 if len(labels) else np.ones(DENSE)
    mean = rows.dense.mean(axis=0) if len(labels) else np.zeros(DENSE)
    m = Machine(0.0, np.zeros(BUCKETS), rng.normal(0, 0.02, (BUCKETS, FACTORS)), np.zeros(DENSE), rng.normal(0, 0.02, (DENSE, FACTORS)), mean, spread)
    share = labels.mean() if len(labels) else 0.5
    if share in (0.0, 1.0):
        m.bias = 3.0 if share else -3.0
        return m
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    parts = {"w": m.w, "v": m.v, "u": m.u, "s": m.s, "bias": np.zeros(1)}
    first = {k: np.zeros_like(x) for k, x in parts.items()}
    second = {k: np.zeros_like(x) for k, x in parts.items()}
    ends, step = np.append(rows.first, len(rows.index)), 0
    for _ in range(epochs):
        for chosen in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // batch)):
            lengths = ends[chosen + 1] - ends[chosen]
            start = np.cumsum(lengths) - lengths
            at = np.arange(lengths.sum()) + np.repeat(ends[chosen] - start, lengths)
            own = Rows(rows.index[at], rows.value[at], start, rows.dense[chosen])
            m.bias = float(parts["bias"][0])
            _, factor, _ = m.sums(own)
            error = (m.score(own) - labels[chosen]) * weight[chosen] / len(chosen)
            d, row = m.standard(own.dense), np.repeat(np.arange(len(chosen)), lengths)
            ex = error[row] * own.value
            gradient = {k: decay * parts[k] for k in parts}
            gradient["w"] = gradient["w"] + np.bincount(own.index, ex, BUCKETS)
            by_word = ex[:, None] * (factor[row] - m.v[own.index] * own.value[:, None])
            gradient["v"] = gradient["v"] + np.stack([np.bincount(own.index, by_word[:, f], BUCKETS) for f in range(FACTORS)], axis=1)
            gradient["u"] = gradient["u"] + d.T @ error
            gradient["s"] = gradient["s"] + (d * error[:, None]).T @ factor - m.s * ((d * d).T @ error)[:, None]
            gradient["bias"] = np.array([error.sum()])
            step += 1
            for k, g in gradient.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                parts[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    m.bias = float(parts["bias"][0])
    return m


def held_out(id_column: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


SAMPLE = "doc_id long, label int, sparse_index binary, sparse_value binary, dense binary"


def sample_rows(docs: DataFrame, labels: DataFrame, most: int) -> tuple[Rows, np.ndarray]:
    """Features and labels of at most `most` labelled ids, in the order of a hash; of an id with several texts the least
    one counts."""
    usable = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    chosen = hash_sample(usable, "doc_id", most)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [features([x or ""]) for x in batch.column(1).to_pylist()]
            arrays = [pa.array([x.astype(t).tobytes() for x in xs], pa.binary()) for xs, t in (([p.index for p in parts], "<i4"), ([p.value for p in parts], "<f4"), ([p.dense for p in parts], "<f8"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *arrays], names=["doc_id", "label", "sparse_index", "sparse_value", "dense"])

    # the sample has at most `most` ids, and one row of each
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).select("doc_id", "text", "label").mapInArrow(rows, SAMPLE).collect()
    found.sort(key=lambda r: (r.doc_id, r.sparse_index))
    index = [np.frombuffer(r.sparse_index, "<i4").astype(np.int64) for r in found]
    sizes = np.array([len(x) for x in index], np.int64)
    if not found:
        return Rows(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros((0, DENSE))), np.zeros(0)
    value = np.concatenate([np.frombuffer(r.sparse_value, "<f4") for r in found]).astype(float)
    return Rows(np.concatenate(index), value, np.cumsum(sizes) - sizes, np.stack([np.frombuffer(r.dense, "<f8") for r in found])), np.array([r.label for r in found], float)


def scored(docs: DataFrame, labels: DataFrame, most: int = 6000, threshold: float = 0.3) -> DataFrame:
    """docs with held_out, score and predicted. labels: doc_id, label (0 or 1; other values and nulls are not used).

    Null and empty texts are scored like texts without words. A score of exactly `threshold` is predicted 1. Of an id that
    is labelled more than once the smaller label counts. Without usable labels scores are near one half. Rows
    repeat as given; an empty table gives an empty one; columns of docs with the added names are replaced. `most`
    bounds the labelled rows that the machine is fitted to.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("held_out", "score", "predicted")
    machine = fit(*sample_rows(docs, labels, most))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    place = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(place).to_pylist()]
            scores = [machine.score(features(texts[part])) for part in byte_groups([len(t) + 1 for t in texts], GROUP_BYTES)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*batch.schema.names, "score"])

    out = docs.mapInArrow(rows, schema)
    return out.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= threshold).cast("int")})
