"""Regular grids, gaps, outliers and base values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import iqr, percentile


def dedup_times(df: DataFrame, by: list[str], t: Column, order: list[str]) -> DataFrame:
    """The first row of each time stamp (``t`` is added as ``t``)."""
    w = Window.partitionBy(*by, "t").orderBy(*order)
    return df.withColumn("t", t).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def grid_fill(df: DataFrame, by: list[str], i: str, value: str, fill: float = 0.0) -> DataFrame:
    """One row for each index from a group's first to its last; missing ones get ``fill``."""
    ends = df.groupBy(*by).agg(F.sequence(F.min(i), F.max(i)).alias("__i"))
    grid = ends.select(*by, F.explode("__i").alias(i))
    return grid.join(df, [*by, i], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def linear_fill(df: DataFrame, by: list[str], x: str, y: str, missing: Column, out: str = "filled") -> DataFrame:
    """Straight lines over missing values, the nearest value beyond the ends."""
    w = Window.partitionBy(*by).orderBy(x)
    known = F.when(~missing, F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    a = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = df.withColumn("__a", a).withColumn("__b", b)
    between = F.col("__a.y") + (F.col("__b.y") - F.col("__a.y")) * (F.col(x) - F.col("__a.x")) / (F.col("__b.x") - F.col("__a.x"))
    return rows.withColumn(out, F.when(~missing, F.col(y)).when(F.col("__a").isNull(), F.col("__b.y")).when(F.col("__b").isNull(), F.col("__a.y")).otherwise(between)).drop("__a", "__b")


def outlier_limits(df: DataFrame, by: list[str], y: str, method: str, factor: float) -> DataFrame:
    """``by, lo, hi`` from the non-zero values: mean and deviations, median and
    interquartile ranges, or fences around the quartiles."""
    v = F.when(F.col(y) != 0, F.col(y))
    if method == "mean":
        lo, hi = F.avg(v) - factor * F.stddev_pop(v), F.avg(v) + factor * F.stddev_pop(v)
    elif method == "median":
        lo, hi = F.median(v) - factor * iqr(v), F.median(v) + factor * iqr(v)
    else:
        lo, hi = percentile(v, 25) - factor * iqr(v), percentile(v, 75) + factor * iqr(v)
    return df.groupBy(*by).agg(lo.alias("lo"), hi.alias("hi"))


def mark_outliers(df: DataFrame, by: list[str], y: str, method: str = "mean", factor: float = 3.0) -> DataFrame:
    """Adds ``is_outlier``; zeros are never outliers."""
    limits = outlier_limits(df, by, y, method, factor)
    out = (F.col(y) != 0) & ((F.col(y) < F.col("lo")) | (F.col(y) > F.col("hi")))
    return df.join(limits, by).withColumn("is_outlier", F.coalesce(out, F.lit(False))).drop("lo", "hi")


def base_value(df: DataFrame, by: list[str], y: str, percent: float = 5.0, least: float | None = None) -> DataFrame:
    """``by, base``: the median of the values up to a low percentile."""
    low = df.groupBy(*by).agg(F.round(percentile(y, percent), 8).alias("__p"))
    v = F.round(F.col(y), 8)
    base = F.median(F.when(v <= F.col("__p"), v))
    out = df.join(low, by).groupBy(*by).agg(base.alias("base"))
    return out if least is None else out.withColumn("base", F.greatest("base", F.lit(least)))
