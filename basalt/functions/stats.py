"""Ranks, percentiles and intervals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: two-sided 95 % normal quantile.
Z95 = 1.959963985


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of hits of n; (0, 1) for n = 0."""
    some = F.nullif(n.cast("double"), F.lit(0.0))
    p, z2 = hits.cast("double") / some, z * z
    middle, spread = p + z2 / (2 * some), z * F.sqrt(p * (1 - p) / some + z2 / (4 * some * some))
    bound = lambda x: x / (1 + z2 / some)
    return F.coalesce(F.greatest(F.lit(0.0), bound(middle - spread)), F.lit(0.0)), F.coalesce(F.least(F.lit(1.0), bound(middle + spread)), F.lit(1.0))


def percent_rank_of_ties(df: DataFrame, value: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean rank of equal values over n - 1, 0.5 for a single row. Ranks come from the histogram of values, so rows are never sorted in one task."""
    keys = list(by)
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    below = F.coalesce(F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.sum("_c").over(w)
    named = [F.col(c).alias(f"_k{i}") for i, c in enumerate([*keys, value])]
    ranks = counts.select(*named, F.when(n > 1, (below + (F.col("_c") - 1) / 2.0) / (n - 1)).otherwise(F.lit(0.5)).alias(out))
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*keys, value])]
    return df.join(ranks, on).select(*df.columns, out)


def nearest_rank(df: DataFrame, value: str, p: float, by: tuple[str, ...] = ()) -> DataFrame:
    """by, value at nearest rank ceil(p * n), n; from the histogram of values."""
    keys = list(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    upto, n = F.sum("_c").over(w.orderBy(value)), F.sum("_c").over(w)
    return counts.withColumns({"_upto": upto, "_n": n}).filter(F.col("_upto") >= F.ceil(F.col("_n") * p)).groupBy(*keys).agg(F.min(value).alias(f"p{round(p * 100)}"), F.max("_n").alias("n"))


def threshold(floor: float, p95: Column) -> Column:
    """The corpus percentile where it is above the floor."""
    return F.greatest(F.lit(floor), F.coalesce(p95.cast("double"), F.lit(floor)))
