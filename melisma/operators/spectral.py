"""Band-limited cosine spectra of contours, their moments and rate shares."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import array_percentile, safe_div


def bessel_i0(x: Column, terms: int = 20) -> Column:
    """Modified Bessel function of order 0 by its power series (for ``x`` up to 10 or so)."""
    out = F.lit(1.0)
    for k in range(1, terms):
        out = out + F.pow(x / 2, 2 * k) / float(math.factorial(k)) ** 2
    return out


def kaiser(k: Column, n: Column, beta: float) -> Column:
    """Weight of sample ``k`` of ``n`` in a periodic Kaiser window."""
    return bessel_i0(beta * F.sqrt(1 - F.pow(2 * k / n - 1, 2))) / bessel_i0(F.lit(float(beta)))


def band_dct(df: DataFrame, by: list[str], i: str, y: str, rate: float, upper: float, lower: float = 0.0, drop_mean: bool = False, beta: float | None = None) -> DataFrame:
    """``by, n, k, f, c``: orthonormal DCT-II coefficients of the contour, under a Kaiser
    window if ``beta`` is given and then centred, up to
    a frequency; ``f = k + rate / 2n``.  Only the few coefficients in the band are
    summed, so a sample meets a handful of rows, not a full transform."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("__k", F.row_number().over(w.orderBy(i)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    rows = rows.withColumn("__y", F.col(y) if beta is None else F.col(y) * kaiser(F.col("__k"), F.col("__n"), beta))
    rows = rows.withColumn("__y", F.col("__y") - F.avg("__y").over(w))
    ks = F.explode(F.sequence(F.lit(1 if drop_mean else 0), F.lit(int(upper))))
    rows = rows.withColumn("k", ks).where(F.col("k") < F.col("__n"))
    cos = F.cos(F.lit(math.pi) * F.col("k") * (2 * F.col("__k") + 1) / (2 * F.col("__n")))
    scale = F.sqrt(F.when(F.col("k") == 0, 1.0).otherwise(2.0) / F.col("__n"))
    out = rows.groupBy(*by, "k", "__n").agg(F.sum(F.col("__y") * cos).alias("__c"))
    out = out.select(*by, F.col("__n").alias("n"), "k", (F.col("k") + F.lit(float(rate)) / (2 * F.col("__n"))).alias("f"), (F.col("__c") * scale).alias("c"))
    return out.where((F.col("f") >= lower) & (F.col("f") <= upper))


def spectral_moments(spec: DataFrame, by: list[str]) -> DataFrame:
    """First three moments of |c| over f, each centred on the one before."""
    a, w = F.abs(F.col("c")), Window.partitionBy(*by)
    total = F.sum(a).over(w)
    rows = spec.withColumn("__a", a).withColumn("__t", total)
    rows = rows.withColumn("__m1", safe_div(F.sum(F.col("__a") * F.col("f")).over(w), F.col("__t")))
    rows = rows.withColumn("__m2", safe_div(F.sum(F.col("__a") * F.pow(F.col("f") - F.col("__m1"), 2)).over(w), F.col("__t")))
    m3 = safe_div(F.sum(F.col("__a") * F.pow(F.col("f") - F.col("__m2"), 3)), F.max("__t"))
    return rows.groupBy(*by).agg(F.max("__m1").alias("sm1"), F.max("__m2").alias("sm2"), m3.alias("sm3"), F.max_by("f", F.struct(F.col("__a"), -F.col("k"))).alias("f_max"))


def rate_share(spec: DataFrame, by: list[str], rate: Column, band: float = 1.0) -> DataFrame:
    """``by, prop, dgm``: the share of |c| within ``band`` of a rate, and the rate's
    distance from the strongest frequency."""
    a = F.abs(F.col("c"))
    near = F.abs(F.col("f") - rate) <= band
    top = F.max_by("f", F.struct(a, -F.col("k")))
    return spec.groupBy(*by).agg(safe_div(F.sum(F.when(near, a).otherwise(0.0)), F.sum(a)).alias("prop"), (F.max(rate) - top).alias("dgm"))


def inverse_dct(spec: DataFrame, by: list[str], n: str) -> DataFrame:
    """``by, i, y``: the contour that the given coefficients make (``n`` samples)."""
    i = F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = spec.withColumn("i", i)
    cos = F.cos(F.lit(math.pi) * F.col("k") * (2 * F.col("i") + 1) / (2 * F.col(n)))
    scale = F.sqrt(F.when(F.col("k") == 0, 1.0).otherwise(2.0) / F.col(n))
    return rows.groupBy(*by, "i").agg(F.sum(F.col("c") * scale * cos).alias("y"))


def spectral_peaks(spec: DataFrame, by: list[str], moment: str, apart: float = 1.0, percent: float = 80.0) -> DataFrame:
    """``by, n_peak, peaks``: frequencies of the local peaks of |c|.

    Peaks rise over the amplitude at a frequency, the ``moment`` of the group, read
    between its neighbours (beyond the spectrum's ends that of the end).  Runs of
    coefficients over it are one peak, and so are runs whose first frequency is within
    ``apart`` of the peak before.  A group has the few coefficients of a band.
    """
    item = F.struct("f", F.abs("c").alias("a"))
    rows = spec.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("__s"), F.max(moment).alias("__m"))
    s, m, n = F.col("__s"), F.col("__m"), F.size("__s")
    low = F.element_at(F.filter(s, lambda e: e["f"] <= m), -1)
    high = F.element_at(F.filter(s, lambda e: e["f"] >= m), 1)
    between = F.when(high["f"] > low["f"], low["a"] + (high["a"] - low["a"]) * (m - low["f"]) / (high["f"] - low["f"])).otherwise(low["a"])
    at = F.coalesce(F.when(m <= F.element_at(s, 1)["f"], F.element_at(s, 1)["a"]).when(m >= F.element_at(s, -1)["f"], F.element_at(s, -1)["a"]).otherwise(between), array_percentile(F.array_sort(F.transform(s, lambda e: e["a"])), F.lit(percent / 100)))
    rows = rows.withColumn("__at", at)
    over = F.filter(F.transform(s, lambda e, k: F.struct(k.alias("k"), e["f"].alias("f"), e["a"].alias("a"))), lambda e: e["a"] >= F.col("__at"))
    none = F.struct(F.array().cast("array<double>").alias("done"), F.lit(-2).alias("k"), F.lit(-1.0).alias("a"), F.lit(0.0).alias("f"))

    def step(acc: Column, e: Column) -> Column:
        first, starts = acc["a"] < 0, (e["k"] > acc["k"] + 1) & (e["f"] > acc["f"] + apart)
        done = F.when(~first & starts, F.array_append(acc["done"], acc["f"])).otherwise(acc["done"])
        better = first | starts | (e["a"] > acc["a"])
        return F.struct(done.alias("done"), e["k"].cast("int").alias("k"), F.when(better, e["a"]).otherwise(acc["a"]).alias("a"), F.when(better, e["f"]).otherwise(acc["f"]).alias("f"))

    rows = rows.withColumn("__p", F.aggregate(over, none, step))
    peaks = F.when(F.col("__p.a") < 0, F.col("__p.done")).otherwise(F.array_append("__p.done", F.col("__p.f")))
    return rows.withColumn("peaks", peaks).select(*by, F.size("peaks").alias("n_peak"), "peaks")


def nearest_peak(rate: Column, peaks: Column) -> Column:
    """Signed distance of a rate from a peak near it.  Going through the peaks, one
    takes over if its distance is less than the signed distance so far, so none
    does after one below the rate."""
    return F.aggregate(peaks, F.lit(math.exp(10)), lambda d, z: F.when(F.abs(rate - z) < d, rate - z).otherwise(d))


def rate_error(spec: DataFrame, by: list[str], rate: Column, n: str, shift: int, band: float = 1.0) -> DataFrame:
    """``by, mae``: mean absolute difference, over a contour's ``n`` samples, of what the
    band's coefficients make and of what those around a rate make.  The latter are
    taken ``shift`` places lower in the spectrum; nothing is scaled."""
    near = F.abs(F.col("f") - rate) <= band
    own = spec.select(*by, n, "k", F.col("c").alias("d"))
    far = spec.where(near).select(*by, n, (F.col("k") - shift).alias("k"))
    values = spec.select(*by, "k", "c")
    far = far.join(values, [*by, "k"], "left").select(*by, n, "k", (-F.coalesce("c", F.lit(0.0))).alias("d"))
    diff = own.unionByName(far).groupBy(*by, n, "k").agg(F.sum("d").alias("d"))
    rows = diff.withColumn("__i", F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1)))
    wave = F.when(F.col("k") == 0, 1.0).otherwise(2.0) * F.cos(F.lit(math.pi) * F.col("k") * (2 * F.col("__i") + 1) / (2 * F.col(n)))
    return rows.groupBy(*by, "__i").agg(F.sum(F.col("d") * wave).alias("__e")).groupBy(*by).agg(F.avg(F.abs("__e")).alias("mae"))


def frequency_bins(spec: DataFrame, by: list[str], lower: float, upper: float, width: float = 1.0) -> DataFrame:
    """``by, f_low, c_sum``: summed |c| in bins of ``width`` between two frequencies, the
    empty ones too."""
    bins = F.explode(F.sequence(F.lit(0), F.lit(max(0, math.ceil((upper - lower) / width) - 1)))).alias("__b")
    grid = spec.select(*by).distinct().select("*", bins)
    sums = spec.where((F.col("f") >= lower) & (F.col("f") < upper)).groupBy(*by, F.floor((F.col("f") - lower) / width).cast("int").alias("__b")).agg(F.sum(F.abs("c")).alias("c_sum"))
    return grid.join(sums, [*by, "__b"], "left").select(*by, (lower + F.col("__b") * width).alias("f_low"), F.coalesce("c_sum", F.lit(0.0)).alias("c_sum"))
