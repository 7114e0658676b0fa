"""Scalar and array functions as column expressions, and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REGISTERS = ["bl", "ml", "tl", "rng"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- times and indices -------------------------------------------------------
def sec2idx(t: str | Column, rate: float, onset: int = 0) -> Column:
    """Sample index of a time: half-even rounding of ``t * rate + onset - 1``."""
    return F.bround(col(t) * rate + (onset - 1), 0).cast("bigint")


def sec2sample(t: str | Column, rate: float, onset: int = 0) -> Column:
    return F.bround(col(t) * rate + onset, 0).cast("bigint")


def idx2sec(i: str | Column, rate: float, onset: int = 0) -> Column:
    return (col(i) + 1 + onset) / F.lit(float(rate))


def sample2sec(i: str | Column, rate: float, onset: int = 0) -> Column:
    return (col(i) + onset) / F.lit(float(rate))


# --- guarded arithmetic ------------------------------------------------------
def safe_div(x: Column, y: Column) -> Column:
    """Null where the divisor is 0, null or not a number."""
    return F.when((y != 0) & ~F.isnan(y.cast("double")), x / y)


def nonzero(x: Column) -> Column:
    """0 becomes 1e-8."""
    return F.when(x == 0, 1e-8).otherwise(x)


def semitone(y: str | Column, base: str | Column) -> Column:
    """12 log2(y / base) of positive values; others lose the base."""
    y, base = col(y), col(base)
    return F.when(y > 0, 12 * F.log2(y / base)).otherwise(y - base)


def hertz(st: str | Column, base: str | Column) -> Column:
    """Inverse of :func:`semitone` for voiced values."""
    return F.pow(F.lit(2.0), col(st) / 12) * col(base)


def minmax(x: Column, low: Column, high: Column, to_low: float = 0.0, to_high: float = 1.0) -> Column:
    return F.when(high > low, to_low + (x - low) / (high - low) * (to_high - to_low)).otherwise(x)


# --- aggregates --------------------------------------------------------------
def mae(x: str | Column, y: str | Column) -> Column:
    return F.avg(F.abs(col(x) - col(y)))


def rss(x: str | Column, y: str | Column) -> Column:
    return F.sum(F.pow(col(x) - col(y), 2))


def mse(x: str | Column, y: str | Column) -> Column:
    return F.avg(F.pow(col(x) - col(y), 2))


def rmsd(x: str | Column, y: str | Column) -> Column:
    return F.sqrt(mse(x, y))


def aic(n: Column, rss_: Column, k: int) -> Column:
    """2k + n ln RSS; 2k for a perfect fit."""
    return F.when(rss_ == 0, F.lit(2.0 * k)).otherwise(2.0 * k + n * F.ln(rss_))


def guarded_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation with defined values for constant input: both constant
    1, one constant 0, fewer than two values 0."""
    x, y = col(x), col(y)
    flat_x, flat_y = F.min(x) == F.max(x), F.min(y) == F.max(y)
    return F.when(F.count(x) <= 1, 0.0).when(flat_x & flat_y, 1.0).when(flat_x | flat_y, 0.0).otherwise(F.corr(x, y))


def percentile(x: str | Column, p: float) -> Column:
    """Exact percentile with linear interpolation, ``p`` in percent."""
    return F.percentile(col(x), F.lit(p / 100))


def iqr(x: str | Column) -> Column:
    return percentile(x, 75) - percentile(x, 25)


def entropy_terms(p: Column) -> Column:
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


# --- arrays ------------------------------------------------------------------
def fit_length(a: Column, n: Column) -> Column:
    """Cut to ``n`` elements or extend by the last one."""
    return F.when(F.size(a) >= n, F.slice(a, F.lit(1), n)).otherwise(F.concat(a, F.array_repeat(F.element_at(a, -1), (n - F.size(a)).cast("int"))))


def array_percentile(sorted_array: Column, p: Column) -> Column:
    """Percentile (0 to 1) of a sorted array, linear between elements."""
    at = (F.size(sorted_array) - 1) * p
    low = F.floor(at).cast("int")
    a = F.element_at(sorted_array, low + 1)
    b = F.element_at(sorted_array, F.least(low + 2, F.size(sorted_array)))
    return a + (b - a) * (at - low)


def fused_percentile(sorted_array: Column, p: float) -> Column:
    """Percentile of a sorted array, ``p`` in percent, linear between elements.  Of the two
    products one is added unrounded, which keeps the value between elements that differ
    in their last digits; rounding both may put it on the upper one."""
    at = (F.size(sorted_array) - 1) * F.lit(p / 100)
    low = F.floor(at).cast("int")
    a, b, step = F.get(sorted_array, low), F.get(sorted_array, low + 1), at - low
    fused = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), a, 1 - step, b * step).cast("double")
    return F.when(step == 0, a).when(a.isNotNull() & b.isNotNull(), fused)


def euclid(a: Column, b: Column, weights: Column | None = None) -> Column:
    """Euclidean distance of two arrays, each coordinate weighted."""
    terms = F.zip_with(a, b, lambda x, y: F.pow(x - y, 2))
    if weights is not None:
        terms = F.zip_with(terms, weights, lambda t, w: t * w)
    return F.sqrt(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t))


def polynomial(coefficients: list[Column], t: Column) -> Column:
    """Value at ``t`` of coefficients in rising order."""
    out = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        out = out * t + c
    return out


def line_cross(icpt_a: Column, slope_a: Column, icpt_b: Column, slope_b: Column) -> tuple[Column, Column]:
    """Where two lines meet; null if they are parallel."""
    t = F.when(slope_a != slope_b, (icpt_b - icpt_a) / (slope_a - slope_b))
    return t, icpt_a + slope_a * t


# --- strings -----------------------------------------------------------------
def clean_spaces(s: str | Column) -> Column:
    return F.regexp_replace(F.trim(col(s)), r"\s+", " ")


def stem(path: str | Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_extract(col(path), r"([^/]*?)(?:\.[^./]*)?$", 1)


def is_pause(label: str | Column, pause: str = "<P>") -> Column:
    """Empty label, or one in which the pause pattern is found."""
    label = F.coalesce(col(label), F.lit(""))
    return (F.length(label) == 0) | label.rlike(pause)


def name_part(name: str | Column, pattern: str, i: int) -> Column:
    """Part ``i`` (from 0) of a name split by a pattern; null beyond the last."""
    return F.get(F.split(col(name), pattern, -1), F.lit(i))


def folder(path: str | Column) -> Column:
    """What is before a path's last slash; empty without one."""
    return F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)


def extension(path: str | Column) -> Column:
    """What follows the last dot of a file's name; empty without one."""
    return F.regexp_extract(col(path), r"\.([^./]*)$", 1)


def same_length(a: Column, b: Column) -> tuple[Column, Column]:
    """Two arrays, each cut to the length of the shorter."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)


def places(n: str | Column, step: int = 1) -> Column:
    """0, 1, ... below ``n``; empty for 0."""
    return F.when(col(n) > 0, F.sequence(F.lit(0).cast("bigint"), col(n).cast("bigint") - 1, F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def is_reference(column: str) -> bool:
    """Whether a column's name says that it tells where a row is from: file, channel,
    segment, tier, time or group."""
    return column in ("fi", "ci", "si", "gi", "stm", "tier", "t_on", "t_off") or column.startswith("grp_")
