"""Moving windows over an index without gaps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import array_percentile

#: Cubic fit over seven points: the centre, and the first three rows of an edge.
SAVGOL_CENTER = [-2, 3, 6, 7, 6, 3, -2]
SAVGOL_EDGE = [[39, 8, -4, -4, 1, 4, -2], [8, 19, 16, 6, -4, -7, 4], [-4, 16, 19, 12, 2, -4, 1]]


def savgol7(df: DataFrame, by: list[str], i: str, y: str, out: str = "smooth") -> DataFrame:
    """Savitzky-Golay smoothing of order 3 over 7 points; groups of up to 7 stay."""
    w = Window.partitionBy(*by).orderBy(i)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rows = df.withColumn("__k", F.row_number().over(w) - 1).withColumn("__n", n)
    at = lambda d: F.col(y) if d == 0 else (F.lead(y, d).over(w) if d > 0 else F.lag(y, -d).over(w))
    dot = lambda c, first, total: sum((at(first + j) * v for j, v in enumerate(c)), F.lit(0.0)) / total
    smooth = F.when(F.col("__n") <= 7, F.col(y))
    for r, c in enumerate(SAVGOL_EDGE):
        smooth = smooth.when(F.col("__k") == r, dot(c, -r, 42)).when(F.col("__k") == F.col("__n") - 1 - r, dot(c[::-1], r - 6, 42))
    return rows.withColumn(out, smooth.otherwise(dot(SAVGOL_CENTER, -3, 21))).drop("__k", "__n")


def edge_window(i: Column, n: Column, half: int) -> tuple[Column, Column]:
    """[on, off) of up to 2 * half samples around ``i``; at an edge it grows to the
    other side until it has 2 * half - 1."""
    on, off = F.greatest(F.lit(0), i - half), F.least(i + half, n)
    short = (2 * half - 1) - (off - on)
    on2 = F.when((short > 0) & (on > 0), F.greatest(F.lit(0), on - short)).otherwise(on)
    off2 = F.when((short > 0) & ~(on > 0) & (off < n), F.least(n, off + short)).otherwise(off)
    return on2, off2


def register_medians(df: DataFrame, by: list[str], i: str, y: str, half: int, p_low: float = 10.0, p_high: float = 90.0) -> DataFrame:
    """Adds ``bl, ml, tl``: per sample the medians of its window's values up to a
    low percentile, of all, and from a high percentile on.

    A row frame bounds what one row looks at, so memory doesn't follow the group.
    """
    w = Window.partitionBy(*by).orderBy(i)
    rows = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    reach = 2 * half - 1
    near = F.collect_list(F.round(F.col(y), 8)).over(w.rowsBetween(-reach, reach))
    on, off = edge_window(F.col("__i"), F.col("__n"), half)
    first = F.greatest(F.lit(0), F.col("__i") - reach)
    rows = rows.withColumn("__w", F.array_sort(F.slice(near, (on - first + 1).cast("int"), (off - on).cast("int"))))
    low = F.round(array_percentile(F.col("__w"), F.lit(p_low / 100)), 8)
    high = F.round(array_percentile(F.col("__w"), F.lit(p_high / 100)), 8)
    rows = rows.withColumn("__lo", low).withColumn("__hi", high)
    few = F.size("__w") <= 2
    half_way = F.lit(0.5)
    return (
        rows.withColumn("bl", array_percentile(F.when(few, F.col("__w")).otherwise(F.filter("__w", lambda v: v <= F.col("__lo"))), half_way))
        .withColumn("ml", array_percentile(F.col("__w"), half_way))
        .withColumn("tl", array_percentile(F.when(few, F.col("__w")).otherwise(F.filter("__w", lambda v: v >= F.col("__hi"))), half_way))
        .drop("__w", "__lo", "__hi", "__i", "__n")
    )


def moving_rms(y: str, by: list[str], i: str, before: int, after: int) -> Column:
    w = Window.partitionBy(*by).orderBy(i).rowsBetween(-before, after)
    return F.sqrt(F.avg(F.pow(F.col(y), 2)).over(w))


def pre_emphasis(y: str, by: list[str], i: str, alpha: float = 0.95) -> Column:
    """y[n] - alpha * y[n - 1]; the first value stays."""
    before = F.lag(y).over(Window.partitionBy(*by).orderBy(i))
    return F.when(before.isNull(), F.col(y)).otherwise(F.col(y) - alpha * before)


def local_maxima(y: str, by: list[str], i: str) -> Column:
    w = Window.partitionBy(*by).orderBy(i)
    return F.coalesce((F.col(y) > F.lag(y).over(w)) & (F.col(y) > F.lead(y).over(w)), F.lit(False))


def frame_energy(samples: DataFrame, by: list[str], i: str, y: str, hop: int, width: int) -> DataFrame:
    """``by, frame, energy``: RMS under a periodic Hamming window of ``width`` samples
    every ``hop``; a sample is dealt to the frames that hold it."""
    first = F.greatest(F.lit(0), F.ceil((F.col(i) - width + 1) / hop))
    frames = samples.withColumn("frame", F.explode(F.sequence(first, F.floor(F.col(i) / hop))))
    weight = 0.54 - 0.46 * F.cos(2 * 3.141592653589793 * (F.col(i) - F.col("frame") * hop) / width)
    return frames.groupBy(*by, "frame").agg(F.sqrt(F.avg(F.pow(F.col(y) * weight, 2))).alias("energy"))


def side_windows(df: DataFrame, by: list[str], i: str, y: str, width: int, side: str, agg) -> DataFrame:
    """Adds ``windowed``: ``agg`` over ``width`` samples that end (``left`` of the sample) or
    begin (``right``) with it; fewer at an edge."""
    w = Window.partitionBy(*by).orderBy(i)
    frame = w.rowsBetween(-(width - 1), 0) if side == "left" else w.rowsBetween(0, width - 1)
    return df.withColumn("windowed", agg(F.col(y)).over(frame))


def smoothed(df: DataFrame, by: list[str], i: str, y: str, how: str, width: int, out: str = "smooth") -> DataFrame:
    """Moving ``mean`` or ``median`` over ``width`` samples (an odd number) around each."""
    half = width // 2
    frame = Window.partitionBy(*by).orderBy(i).rowsBetween(-half, half)
    return df.withColumn(out, F.avg(y).over(frame) if how == "mean" else F.percentile(F.col(y), F.lit(0.5)).over(frame))


def window_weight(kind: str, k: Column, n: Column) -> Column:
    """Weight of sample ``k`` of ``n`` in a periodic window: none, hamming, hann or triang."""
    turn = 2 * math.pi * k / n
    return {"none": F.lit(1.0), "hamming": 0.54 - 0.46 * F.cos(turn), "hann": 0.5 - 0.5 * F.cos(turn), "triang": 1 - F.abs((2 * k - n) / (n + F.when(n % 2 == 1, 1).otherwise(0)))}[kind]


def level_db(rms: Column, reference: float) -> Column:
    """A level in dB over a reference; null for silence."""
    return F.when(rms > 0, 20 * F.log10(rms / reference))


#: Fixed value: the reference pressure in air, in Pa.
PRESSURE = 2e-5
