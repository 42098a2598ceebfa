"""Fits of the confidence model: logistic regression, then isotonic regression, for each field group."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrust.operators import merge as M
from fieldtrust.operators.evaluate import choose_thresholds
from fieldtrust.operators.scan import in_ranges
from fieldtrust.scratch import saved

#: Rows that a group needs; with fewer, or with one outcome only, it keeps the default model.
LEAST_ROWS = 30
#: A table of at most this many groups is broadcast; a larger one is joined by a shuffle.
MOST_GROUPS = 10_000


class Calibrator(NamedTuple):
    grp: str
    features: list[str]
    weights: list[float]
    bias: float
    iso_x: list[float]
    iso_y: list[float]
    threshold: float


SCHEMA = "grp string, features array<string>, weights array<double>, bias double, iso_x array<double>, iso_y array<double>, threshold double"


def default(grp: str) -> Calibrator:
    return Calibrator(grp, M.FEATURES, M.WEIGHTS, M.BIAS, [], [], M.THRESHOLD)


def fit_logistic(rows: DataFrame, l2: float = 1.0, tolerance: float = 1e-8, most: int = 50) -> DataFrame:
    """grp, weights, bias of each group of rows (grp, vector ARRAY<DOUBLE> of one length, y 0/1): those that minimise log
    loss + l2/2 |w|^2, the bias free.

    Newton's method for all groups at once: a step is one aggregation (the gradient and the upper triangle of the Hessian
    of each group, added up before the shuffle) and one small solve for each group. Steps end when none moves by more than
    the tolerance. Vectors and outcomes of null are left out; an empty table gives no groups."""
    data = saved(rows.where("vector is not null and y is not null").select("grp", F.concat("vector", F.array(F.lit(1.0))).alias("a"), F.col("y").cast("double").alias("y")), "fit")
    first = data.select(F.size("a")).first()
    m = first[0] if first else 1
    cells = [(i, j) for i in range(m) for j in range(i, m)]
    models = saved(data.select("grp").distinct().select("grp", F.array_repeat(F.lit(0.0), m).alias("w"), F.lit(0.0).alias("moved")), "models")
    a = lambda i: F.get("a", F.lit(i))

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ridge = np.diag([l2] * (m - 1) + [0.0])
        for pdf in batches:
            made = []
            for w, g, h in zip(pdf["w"], pdf["g"], pdf["h"], strict=True):
                hessian = np.zeros((m, m))
                for (i, j), v in zip(cells, h, strict=True):
                    hessian[i, j] = hessian[j, i] = v
                step = np.linalg.solve(hessian + ridge + 1e-9 * np.eye(m), np.asarray(g) + ridge @ w)
                made.append((w - step, float(np.abs(step).max())))
            yield pd.DataFrame({"grp": pdf["grp"], "w": [x for x, _ in made], "moved": [x for _, x in made]})

    for _ in range(most if first else 0):
        few = models.select(F.col("grp").alias("_grp"), "w")
        placed = data.join(F.broadcast(few) if models.count() <= MOST_GROUPS else few, F.col("grp").eqNullSafe(F.col("_grp")))
        z = F.aggregate(F.zip_with("w", "a", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        known = placed.withColumn("p", 1 / (1 + F.exp(-z))).withColumns({"e": F.col("p") - F.col("y"), "v": F.col("p") * (1 - F.col("p"))})
        sums = known.groupBy("grp").agg(F.first("w").alias("w"), *[F.sum(F.col("e") * a(i)).alias(f"g{i}") for i in range(m)], *[F.sum(F.col("v") * a(i) * a(j)).alias(f"h{i}_{j}") for i, j in cells])
        asked = sums.select("grp", "w", F.array(*[f"g{i}" for i in range(m)]).alias("g"), F.array(*[f"h{i}_{j}" for i, j in cells]).alias("h"))
        models = saved(asked.mapInPandas(solved, models.schema), "models")
        if (models.agg(F.max("moved")).first()[0] or 0.0) < tolerance:
            break
    return models.select("grp", F.slice("w", 1, m - 1).alias("weights"), F.element_at("w", -1).alias("bias"))


BLOCKS = "part int, lo double, hi double, n long, s double"


def _pool(blocks: Iterable[tuple]) -> list[list]:
    """Adjacent violators among blocks (lo, hi, n, s) in rising order pooled until their means rise."""
    out: list[list] = []
    for lo, hi, n, s in blocks:
        out.append([lo, hi, n, s])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, hi, n, s = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = hi, out[-1][2] + n, out[-1][3] + s
    return out


def isotonic_blocks(scores: DataFrame) -> DataFrame:
    """grp, lo, hi, n, mean: the blocks of the isotonic regression of y on p in each group of scores (grp, p, y).

    Equal scores are one point from the start. Points lie in ranges of (group, score); each range pools its own violators,
    and blocks of neighbouring ranges are pooled again, 16 ranges at a time: pooling blocks gives what pooling their points
    gives. Only blocks move on, and with outcomes of 0 and 1 those of n rows are at most about n^(2/3). Null scores and
    outcomes are left out."""
    points = scores.where("p is not null and y is not null").groupBy("grp", "p").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("double")).alias("s"))
    kind = points.schema["grp"].dataType.simpleString()

    def pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, current, held = TaskContext.get().partitionId(), None, []

        def done() -> pd.DataFrame:
            return pd.DataFrame([(current[0], part, *b) for b in held], columns=["grp", "part", "lo", "hi", "n", "s"])

        for pdf in batches:
            for grp, own in pdf.groupby("grp", sort=False, dropna=False):
                key = (None if pd.isna(grp) else grp,)
                if current is not None and key != current:
                    yield done()
                    held = []
                current = key
                held = _pool([*held, *zip(own["p"], own["p"], own["n"], own["s"], strict=True)])
        if current is not None:
            yield done()

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lo")
        made = _pool(zip(pdf["lo"], pdf["hi"], pdf["n"], pdf["s"], strict=True))
        return pd.DataFrame([(pdf["grp"].iloc[0], pdf["part"].min() // 16, *b) for b in made], columns=["grp", "part", "lo", "hi", "n", "s"])

    blocks = saved(in_ranges(points, ["grp", "p"]).mapInPandas(pooled, f"grp {kind}, {BLOCKS}"), "blocks")
    ranges = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    while ranges > 1:
        blocks = saved(blocks.groupBy("grp", F.floor(F.col("part") / 16).alias("_to")).applyInPandas(merged, blocks.schema), "blocks")
        ranges = -(-ranges // 16)
    return blocks.select("grp", "lo", "hi", "n", (F.col("s") / F.col("n")).alias("mean"))


def fit_isotonic(scores: DataFrame) -> DataFrame:
    """grp, iso_x, iso_y: rising knots at both ends of each block of isotonic_blocks."""
    blocks = F.array_sort(F.collect_list(F.struct("lo", "hi", "mean")))
    ends = lambda f: F.flatten(F.transform("blocks", f))
    return isotonic_blocks(scores).groupBy("grp").agg(blocks.alias("blocks")).select("grp", ends(lambda b: F.array(b["lo"], b["hi"])).alias("iso_x"), ends(lambda b: F.array(b["mean"], b["mean"])).alias("iso_y"))


def fit_calibrators(rows: DataFrame, target: float = 0.99) -> DataFrame:
    """A table (SCHEMA) with one calibrator for each group of rows (grp, split, features MAP, y). Rows of the test split
    are refused. Groups with fewer than LEAST_ROWS rows, or with one outcome only, keep the default model. All groups are
    fitted together, each step over all of them at once."""
    if not rows.where("split = 'test'").isEmpty():
        raise ValueError("the test split is not for fitting")
    whole = rows.where("features is not null and y is not null").select("grp", M.feature_vector(F.col("features")).alias("vector"), F.col("y").cast("long").alias("y"))
    groups = saved(whole.groupBy("grp").agg(F.count("*").alias("n"), F.sum("y").alias("right")), "groups")
    fit = groups.where((F.col("n") >= LEAST_ROWS) & (F.col("right") > 0) & (F.col("right") < F.col("n"))).select(F.col("grp").alias("_grp"))
    own = saved(whole.join(F.broadcast(fit) if fit.count() <= MOST_GROUPS else fit, F.col("grp").eqNullSafe(F.col("_grp")), "left_semi"), "own")
    linear = saved(fit_logistic(own), "linear")

    def beside(df: DataFrame, table: DataFrame) -> DataFrame:
        table = table.withColumnRenamed("grp", "_g")
        return df.join(F.broadcast(table) if table.count() <= MOST_GROUPS else table, F.col("grp").eqNullSafe(F.col("_g"))).drop("_g")

    z = F.aggregate(F.zip_with("weights", "vector", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) + F.col("bias")
    knots = saved(fit_isotonic(beside(own, linear).select("grp", (1 / (1 + F.exp(-z))).alias("p"), "y")), "knots")
    models = saved(beside(linear, knots), "models")
    p = M.scored(F.col("vector"), F.col("weights"), F.col("bias"), F.col("iso_x"), F.col("iso_y"))
    taus = choose_thresholds(beside(own, models).select("grp", p.alias("p"), "y"), target).select("grp", F.col("tau").alias("threshold"))
    fitted = beside(models, taus).select("grp", F.array(*map(F.lit, M.FEATURES)).alias("features"), "weights", "bias", "iso_x", "iso_y", "threshold")
    d = default("")
    numbers = lambda xs: F.array(*map(F.lit, xs)).cast("array<double>")
    others = groups.join(fit, F.col("grp").eqNullSafe(F.col("_grp")), "left_anti").select("grp", F.array(*map(F.lit, d.features)).alias("features"), numbers(d.weights).alias("weights"), F.lit(d.bias).alias("bias"), numbers(d.iso_x).alias("iso_x"), numbers(d.iso_y).alias("iso_y"), F.lit(d.threshold).alias("threshold"))
    return fitted.unionByName(others)


def save_calibrators(table: DataFrame, path: str, version: str) -> None:
    table.write.mode("overwrite").parquet(f"{path}/version={version}")


def load_calibrators(spark, path: str, version: str) -> DataFrame:
    """The table of a version; refused if it was made for another order of features."""
    table = spark.read.schema(SCHEMA).parquet(f"{path}/version={version}")
    if not table.where(F.col("features") != F.array(*map(F.lit, M.FEATURES))).isEmpty():
        raise ValueError("calibrator of another feature layout")
    return table


def with_confidence(fields: DataFrame, calibrators: DataFrame) -> DataFrame:
    """fields (grp, features) with confidence and threshold of their group's calibrator; groups without one use the
    default. Up to MOST_GROUPS calibrators are broadcast."""
    c = calibrators.select("grp", "weights", "bias", "iso_x", "iso_y", "threshold")
    c = F.broadcast(c) if calibrators.count() <= MOST_GROUPS else c
    joined = fields.join(c, "grp", "left")
    w = F.coalesce("weights", F.array(*map(F.lit, M.WEIGHTS)))
    none = F.array().cast("array<double>")
    p = M.scored(M.feature_vector(F.col("features")), w, F.coalesce("bias", F.lit(M.BIAS)), F.coalesce("iso_x", none), F.coalesce("iso_y", none))
    return joined.withColumns({"confidence": p, "threshold": F.coalesce("threshold", F.lit(M.THRESHOLD))}).drop("weights", "bias", "iso_x", "iso_y")
