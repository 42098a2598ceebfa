"""Global row numbers without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrust.operators.scan import running_sums


def with_rank(df: DataFrame, *order: str, out: str = "rank") -> DataFrame:
    """Adds a 1-based row number over the whole table. order must be total (end it with an id)."""
    return running_sums(df, list(order), {out: None})


def mass_bin(rank: Column, n: Column, bins: int) -> Column:
    """0-based bin of equal mass: the first n % bins bins hold one row more; no more bins than rows."""
    k = F.least(F.lit(bins).cast("long"), n)
    size, larger = F.floor(n / k), n % k
    edge = larger * (size + 1)
    return F.when(rank <= edge, F.floor((rank - 1) / (size + 1))).otherwise(larger + F.floor((rank - 1 - edge) / F.greatest(size, F.lit(1))))
