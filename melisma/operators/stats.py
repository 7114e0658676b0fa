"""Grouped statistics, normalization, information measures and summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import entropy_terms, iqr, polynomial, safe_div


def std_feat(y: str, i: str, rate: float) -> list[Column]:
    """Mean, deviation, median, interquartile range, extremes, place of the maximum
    (first of equal ones, as a share of the length) and duration."""
    n = F.count(F.lit(1))
    top = F.max(F.struct(F.col(y).alias("y"), (-F.col(i)).alias("i")))
    return [
        F.avg(y).alias("m"), F.stddev_pop(y).alias("sd"), F.median(y).alias("med"), iqr(y).alias("iqr"), F.max(y).alias("max"), F.min(y).alias("min"),
        ((-top["i"] - F.min(i) + 1) / n).alias("maxpos"), (n / F.lit(float(rate))).alias("dur"),
    ]


def normalized(df: DataFrame, features: list[str], suffix: str = "_nrm", ref: str = "ref_") -> DataFrame:
    """Adds each feature over its reference value; a reference of 0 counts as 1."""
    for f in features:
        d = F.col(f"{ref}{f}")
        df = df.withColumn(f"{f}{suffix}", F.col(f) / F.when(d == 0, 1.0).otherwise(d))
    return df


def quotients(df: DataFrame, by: list[str], i: str, y: str, head: int) -> DataFrame:
    """Initial, final and both-end mean quotients over windows of ``head`` samples;
    only positive denominators count."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("__k", F.row_number().over(w.orderBy(i)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    k, n = F.col("__k"), F.col("__n")
    wl = F.least(n, F.lit(head))
    last, first = k == n - 1, k == 0
    mean = lambda cond: F.avg(F.when(cond, F.col(y)))
    rows = rows.groupBy(*by).agg(
        mean(k < wl).alias("__i"), F.coalesce(mean(k >= wl), mean(last)).alias("__ni"),
        mean(k >= n - wl).alias("__f"), F.coalesce(mean(k < n - wl), mean(first)).alias("__nf"),
    )
    q = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    out = rows.select(*by, q("__i", "__ni").alias("qi"), q("__f", "__nf").alias("qf"), q("__i", "__f").alias("qb"))
    return out.withColumn("qm", F.greatest("qi", "qf"))


def periods(df: DataFrame, by: list[str], t: str, t_min: float, t_max: float, fac_max: float) -> DataFrame:
    """Each period ``__d`` that counts, its successor ``__e`` and the time ``__t1`` between
    them: both in range, neither much the longer."""
    w = Window.partitionBy(*by).orderBy(t)
    rows = df.withColumn("__t1", F.lead(t).over(w)).withColumn("__d", F.col("__t1") - F.col(t))
    rows = rows.withColumn("__e", F.lead("__d").over(w))
    return rows.where(F.col("__d").between(t_min, t_max) & F.col("__e").between(t_min, t_max) & (F.greatest("__d", "__e") <= fac_max * F.least("__d", "__e")))


def jitter(df: DataFrame, by: list[str], t: str, t_min: float, t_max: float, fac_max: float) -> DataFrame:
    """Mean absolute difference of adjacent periods, absolute and relative, with the
    mean and deviation of the periods used."""
    use = periods(df, by, t, t_min, t_max, fac_max)
    use = use.groupBy(*by).agg(F.avg(F.abs(F.col("__d") - F.col("__e"))).alias("jit_abs"), F.avg("__d").alias("jit_m"), F.stddev_pop("__d").alias("jit_sd"), F.count(F.lit(1)).alias("n"))
    return use.withColumn("jit", safe_div(F.col("jit_abs"), F.col("jit_m")))


def shimmer(df: DataFrame, by: list[str], t: str, amplitude: str) -> DataFrame:
    """Mean absolute difference of successive amplitudes over their mean."""
    w = Window.partitionBy(*by).orderBy(t)
    a = F.abs(F.col(amplitude))
    rows = df.withColumn("__a", a).withColumn("__d", F.abs(a - F.abs(F.lag(amplitude).over(w))))
    return rows.groupBy(*by).agg(safe_div(F.avg("__d"), F.avg("__a")).alias("shim"), F.avg("__a").alias("shim_m"), F.stddev_pop("__a").alias("shim_sd"))


def entropy(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Shannon entropy (bits) of a column's values per group."""
    n = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return n.withColumn("__h", entropy_terms(p)).groupBy(*by).agg(F.sum("__h").alias("entropy"))


def information(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: mutual information of two columns, H(y|x) and H(x|y), in bits."""
    n = df.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))
    both = n.withColumn("nx", F.sum("n").over(Window.partitionBy(x))).withColumn("ny", F.sum("n").over(Window.partitionBy(y)))
    total = F.broadcast(n.agg(F.sum("n").alias("total")))
    p = both.crossJoin(total)
    share = F.col("n") / F.col("total")
    return p.agg(
        F.sum(share * F.log2(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))).alias("mi"),
        F.sum(-share * F.log2(F.col("n") / F.col("nx"))).alias("h_y_x"),
        F.sum(-share * F.log2(F.col("n") / F.col("ny"))).alias("h_x_y"),
    )


def summary_long(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """``keys, feat`` and mean, median, deviation and interquartile range."""
    long = df.unpivot(keys, features, "feat", "v")
    return long.groupBy(*keys, "feat").agg(F.avg("v").alias("m"), F.median("v").alias("med"), F.stddev_pop("v").alias("sd"), iqr("v").alias("iqr"))


def summary_wide(df: DataFrame, key: str, tier: str, tiers: list[str], features: list[str]) -> DataFrame:
    """One row per key with columns ``<tier>_<feat>_<stat>``; the tiers are given,
    so no pass is spent on finding them."""
    stats = {"m": F.avg, "med": F.median, "sd": F.stddev_pop, "iqr": iqr}
    cells = [f(F.when(F.col(tier) == t, F.col(v))).alias(f"{t}_{v}_{s}") for t in tiers for v in features for s, f in stats.items()]
    return df.groupBy(key).agg(*cells)


def normalize(df: DataFrame, by: list[str], x: str, how: str, out: str) -> DataFrame:
    """minmax to [0, 1], zscore, or std (divided by the deviation only)."""
    w = Window.partitionBy(*by)
    v, lo, hi, m, sd = F.col(x), F.min(x).over(w), F.max(x).over(w), F.avg(x).over(w), F.stddev_pop(x).over(w)
    value = {"minmax": F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(v), "zscore": safe_div(v - m, sd), "std": safe_div(v, sd)}[how]
    return df.withColumn(out, value)


def imputed(df: DataFrame, by: list[str], columns: list[str], how: str | float = "mean") -> DataFrame:
    """Null, NaN and infinite values replaced by the group's ``mean`` or ``median`` of the
    others, or by a number; a group without others keeps nulls."""
    w = Window.partitionBy(*by)
    for c in columns:
        v = F.col(c).cast("double")
        fine = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
        other = F.lit(float(how)) if not isinstance(how, str) else (F.avg(fine) if how == "mean" else F.percentile(fine, F.lit(0.5))).over(w)
        df = df.withColumn(c, F.coalesce(fine, other))
    return df


def mean_curves(df: DataFrame, by: list[str], coefficients: list[str], points: int = 100, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """``by, n, x, y``: the mean polynomial of each group (coefficients in rising order)
    at evenly spaced places."""
    mean = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in coefficients))
    at = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("__k")
    x = low + F.col("__k") * ((high - low) / (points - 1))
    rows = mean.select("*", at).withColumn("x", x)
    return rows.select(*by, "n", "x", polynomial([F.col(c) for c in coefficients], F.col("x")).alias("y"))


def group_key(df: DataFrame, parts: list[str], missing: str = "#", separator: str = "_") -> Column:
    """One key of several columns; a column that is absent or null gives ``missing``."""
    return F.concat_ws(separator, *(F.coalesce(F.col(p).cast("string"), F.lit(missing)) if p in df.columns else F.lit(missing) for p in parts))


def one_of_redundant(df: DataFrame, pattern: str, name: str) -> DataFrame:
    """Columns whose name has the pattern hold the same: the first value that one of
    them has becomes ``name``, they go."""
    same = sorted(c for c in df.columns if re.search(pattern, c))
    if not same:
        return df
    return df.withColumn("__one", F.coalesce(*same)).drop(*same).withColumnRenamed("__one", name)


def by_channel(df: DataFrame, channel: str = "ci") -> DataFrame:
    """Columns ``<name>_<channel>_rate`` as one ``<name>_rate``: a row's value is that of
    its own channel (columns count from 1)."""
    found: dict[str, list[tuple[int, str]]] = {}
    for c in df.columns:
        if m := re.fullmatch(r"(.+)_(\d+)_rate", c):
            found.setdefault(f"{m[1]}_rate", []).append((int(m[2]), c))
    for name, columns in found.items():
        value = F.coalesce(*(F.when(F.col(channel) == k - 1, F.col(c)) for k, c in columns))
        df = df.withColumn(name, value).drop(*(c for _, c in columns))
    return df
