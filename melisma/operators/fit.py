"""Least-squares fits as aggregates, and what is measured on fitted lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import aic, guarded_corr, rss, safe_div


def unit_time(by: list[str], i: str, low: float = 0.0, high: float = 1.0) -> Column:
    """Time of a sample scaled to [low, high] over its group."""
    w = Window.partitionBy(*by)
    a, b = F.min(i).over(w), F.max(i).over(w)
    return F.when(b > a, low + (F.col(i) - a) / (b - a) * (high - low)).otherwise(F.lit(low))


def line_fit(y: str, t: str) -> list[Column]:
    """Slope and intercept; a group without spread in time has slope 0 and its mean."""
    flat = F.min(t) == F.max(t)
    return [F.when(flat, 0.0).otherwise(F.regr_slope(y, t)).alias("slope"), F.when(flat, F.avg(y)).otherwise(F.regr_intercept(y, t)).alias("icpt")]


def power_sums(t: str, y: str, order: int) -> list[Column]:
    """Sums of t^k (k up to twice the order) and of t^k y: all that a polynomial
    fit needs, so partial sums combine before the shuffle."""
    tk = [F.sum(F.pow(F.col(t), k)).alias(f"s{k}") for k in range(2 * order + 1)]
    return tk + [F.sum(F.pow(F.col(t), k) * F.col(y)).alias(f"m{k}") for k in range(order + 1)]


def _determinant(m: list[list[Column]]) -> Column:
    if len(m) == 1:
        return m[0][0]
    out = None
    for j, a in enumerate(m[0]):
        term = a * _determinant([row[:j] + row[j + 1 :] for row in m[1:]])
        out = term if out is None else (out - term if j % 2 else out + term)
    return out


def polynomial_fit(df: DataFrame, by: list[str], t: str, y: str, order: int) -> DataFrame:
    """``by, c0..c<order>`` in rising order, by Cramer's rule on power sums; a group
    of no more values than the order has its mean as ``c0`` and zeros."""
    sums = df.groupBy(*by).agg(*power_sums(t, y, order))
    k = order + 1
    matrix = [[F.col(f"s{i + j}") for j in range(k)] for i in range(k)]
    sums = sums.withColumn("__det", _determinant(matrix))
    out = []
    for j in range(k):
        swapped = [[F.col(f"m{i}") if c == j else matrix[i][c] for c in range(k)] for i in range(k)]
        few = F.when(F.col("s0") <= order, (F.col("m0") / F.col("s0")) if j == 0 else F.lit(0.0))
        out.append(few.otherwise(safe_div(_determinant(swapped), F.col("__det"))).alias(f"c{j}"))
    return sums.select(*by, *out)


def residual(y: Column, slope: Column, icpt: Column, t: Column) -> Column:
    return y - (slope * t + icpt)


def range_residual(y: Column, low: Column, high: Column) -> Column:
    """A value's place between base and top line; as it is where they cross."""
    return F.when(high > low, (y - low) / (high - low)).otherwise(y)


def center_time(t: Column, center: Column, on: Column, off: Column) -> Column:
    """Time with 0 at the centre: [-1, 0] before it, (0, 1] after."""
    return F.when(t <= center, F.when(center > on, (t - center) / (center - on)).otherwise(0.0)).otherwise((t - center) / (off - center))


def boundary_features(df: DataFrame, pair: list[str], t: str, y: str, side: str) -> DataFrame:
    """Discontinuity between the two sides (``side`` 0 and 1) of each pair: lines
    through both and through each, compared.

    reset ``r``, onset and mean distances, RMSD of joint against separate lines,
    slope differences, (1 - r) / 2, RMSE ratio and AIC gain, each for the whole and
    for the parts where that has a meaning.
    """
    sides = df.groupBy(*pair, side).agg(*line_fit(y, t))
    joint = df.groupBy(*pair).agg(*line_fit(y, t)).withColumnsRenamed({"slope": "slope_ab", "icpt": "icpt_ab"})
    rows = df.join(sides, [*pair, side]).join(joint, pair)
    rows = rows.withColumn("__own", F.col("slope") * F.col(t) + F.col("icpt")).withColumn("__ab", F.col("slope_ab") * F.col(t) + F.col("icpt_ab"))
    gap = F.min(F.when(F.col(side) == 1, F.col(t))) - F.max(F.when(F.col(side) == 0, F.col(t)))
    return rows.groupBy(*pair).agg(*boundary_measures(t, y, side), gap.alias("p"))


def boundary_measures(t: str, y: str, side: str, shared: Column | None = None) -> list[Column]:
    """Aggregates over samples that carry their side's line (``__own``, ``slope``)
    and the joint one (``__ab``, ``slope_ab``); ``shared`` marks samples of side 0
    that side 1 has too, which only count where a line's own ends and mean do."""
    once = F.lit(True) if shared is None else ~shared
    own, ab, v = F.col("__own"), F.col("__ab"), F.col(y)
    part = lambda k, c: F.when(F.col(side) == k, c)
    out = []
    for name, k in (("", None), ("_pre", 0), ("_post", 1)):
        p = (lambda c: F.when(once, c)) if k is None else (lambda c, k=k: F.when(once & (F.col(side) == k), c))
        x, z, w = p(own), p(ab), p(v)
        out.append(F.sqrt(F.avg(F.pow(x - z, 2))).alias(f"rms{name}"))
        out.append(safe_div(F.sqrt(F.avg(F.pow(z - w, 2))), F.sqrt(F.avg(F.pow(x - w, 2)))).alias(f"rmsR{name}"))
        out.append(((1 - guarded_corr(x, z)) / 2).alias(f"corrD{name}"))
        n = F.count(w)
        out.append((aic(n, rss(z, w), 3) - aic(n, rss(x, w), 6 if k is None else 3)).alias(f"aicI{name}"))
    pre, post = (lambda c: F.max(part(0, c))), (lambda c: F.max(part(1, c)))
    first_b, last_a = F.min_by(own, part(1, F.col(t))), F.max_by(own, part(0, F.col(t)))
    return out + [
        (first_b - last_a).alias("r"),
        (F.min_by(own, part(0, F.col(t))) - first_b).alias("d_o"),
        (F.avg(part(0, own)) - F.avg(part(1, own))).alias("d_m"),
        (pre(F.col("slope")) - post(F.col("slope"))).alias("sd_prepost"),
        (F.max("slope_ab") - pre(F.col("slope"))).alias("sd_pre"),
        (F.max("slope_ab") - post(F.col("slope"))).alias("sd_post"),
    ]


def gestalt(df: DataFrame, by: list[str], order: str, local: str, parent: str) -> DataFrame:
    """Local against parent line on the same samples: RMS, mean, slope and edge differences."""
    return df.groupBy(*by).agg(*gestalt_measures(order, local, parent))


def gestalt_measures(order: str, local: str, parent: str, prefix: str = "") -> list[Column]:
    d = F.col(local) - F.col(parent)
    first, last = F.min_by(d, F.col(order)), F.max_by(d, F.col(order))
    values = {"rms": F.sqrt(F.avg(d * d)), "d": F.avg(d), "sd": (last - first) / F.count(F.lit(1)), "d_init": first, "d_fin": last}
    return [v.alias(f"{prefix}{n}") for n, v in values.items()]
