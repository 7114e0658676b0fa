"""Relations between times, points and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def range_join(points: DataFrame, spans: DataFrame, by: list[str], t: str, on: str, off: str, bin_width: float, how: str = "left") -> DataFrame:
    """Points with the spans that hold them, ends included.

    An interval is dealt to each bin of ``bin_width`` that it touches and the join
    is an equi-join on (``by``, bin), so its work follows the matches and not the
    product of the sides.
    """
    spans = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(on) / bin_width), F.floor(F.col(off) / bin_width))))
    rest = [c for c in spans.columns if c not in [*by, "__bin"]]
    spans = spans.select(*(F.col(c).alias(f"__s_{c}") for c in spans.columns))
    points = points.withColumn("__bin", F.floor(F.col(t) / bin_width))
    held = (F.col(t) >= F.col(f"__s_{on}")) & (F.col(t) <= F.col(f"__s_{off}"))
    for c in [*by, "__bin"]:
        held = held & (F.col(c) == F.col(f"__s_{c}"))
    joined = points.join(spans, held, how)
    return joined.select(*(c for c in points.columns if c != "__bin"), *(F.col(f"__s_{c}").alias(c) for c in rest))


def link_parent(points: DataFrame, spans: DataFrame, by: list[str], key: str, t: str, on: str, off: str, idx: str, bin_width: float) -> DataFrame:
    """``by, key, parent``: the first span that holds the point, else -1."""
    found = range_join(points.select(*by, key, t), spans.select(*by, on, off, idx), by, t, on, off, bin_width)
    return found.groupBy(*by, key).agg(F.coalesce(F.min(idx), F.lit(-1)).alias("parent"))


def initial_final(linked: DataFrame, by: list[str], order: str, parent: str = "parent") -> DataFrame:
    """Adds ``is_init, is_fin``: whether the neighbour has another parent."""
    w = Window.partitionBy(*by).orderBy(order)
    before, after = F.lag(parent).over(w), F.lead(parent).over(w)
    yes = lambda c: F.when(c.isNull() | (c != F.col(parent)), "yes").otherwise("no")
    return linked.withColumn("is_init", yes(before)).withColumn("is_fin", yes(after))


def point_to_segment(points: DataFrame, by: list[str], t: str, chunk_on: str) -> DataFrame:
    """Right-boundary points to segments ``on, off``; onsets start anew at a chunk."""
    before = F.lag(t).over(Window.partitionBy(*by).orderBy(t))
    return points.withColumn("on", F.greatest(F.coalesce(before, F.col(chunk_on)), F.col(chunk_on))).withColumn("off", F.col(t))


def point_window(t: Column, width: float) -> list[Column]:
    """A point's segment: on (not below 0), off, centre, to two decimals."""
    return [F.round(F.greatest(t - width / 2, F.lit(0.0)), 2).alias("on"), F.round(t + width / 2, 2).alias("off"), F.round(t, 2).alias("center")]


def norm_window(center: Column, on: Column, off: Column, parent_on: Column, parent_off: Column, width: float) -> list[Column]:
    """A normalization window around the centre: not inside the segment, not outside its parent."""
    low = F.greatest(F.least(center - width / 2, on), parent_on)
    high = F.least(F.greatest(center + width / 2, off), parent_off)
    return [low.alias("nrm_on"), high.alias("nrm_off")]


def merge_points(linked: DataFrame, by: list[str], t: str, label: str, how: str) -> DataFrame:
    """One point per group: the ``left`` or ``right`` one, or (``skip``) groups of
    exactly one point."""
    pick = F.max_by if how == "right" else F.min_by
    out = linked.groupBy(*by).agg(pick(t, t).alias("t"), pick(label, t).alias("label"), F.count(F.lit(1)).alias("n"))
    return out.where("n = 1") if how == "skip" else out


def overlap(on_a: Column, off_a: Column, on_b: Column, off_b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(off_a, off_b) - F.greatest(on_a, on_b))


def asof_previous(left: DataFrame, right: DataFrame, by: list[str], t: str, value: str) -> DataFrame:
    """Adds the last ``value`` of ``right`` strictly before ``t`` in each ``left``
    row: one sorted pass over the union, no join."""
    both = left.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__side", F.lit(0)).unionByName(
        right.select(*by, t, F.col(value).alias("__v"), F.lit(1).alias("__side")), allowMissingColumns=True)
    # Left rows come first among equal times, so an equal time is not seen.
    w = Window.partitionBy(*by).orderBy(t, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("previous", F.last("__v", ignorenulls=True).over(w)).where("__side = 0").drop("__v", "__side")


def islands(df: DataFrame, by: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs from 0: a run begins where ``starts`` holds."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def complement(spans: DataFrame, by: list[str], on: str, off: str, low: Column, high: Column) -> DataFrame:
    """Gaps between spans, and before the first and after the last, in [low, high]."""
    w = Window.partitionBy(*by).orderBy(on)
    rows = spans.withColumn("__prev", F.lag(off).over(w)).withColumn("__last", F.lead(on).over(w).isNull()).withColumn("__lo", low).withColumn("__hi", high)
    gaps = F.array(
        F.struct(F.coalesce("__prev", "__lo").alias("on"), F.col(on).alias("off")),
        F.struct(F.when(F.col("__last"), F.col(off)).alias("on"), F.col("__hi").alias("off")),
    )
    return rows.select(*by, F.explode(gaps).alias("g")).select(*by, "g.on", "g.off").where("off > on")


def fill_gaps(items: DataFrame, by: list[str], on: str, off: str, label: str, end: Column, pause: str = "") -> DataFrame:
    """Intervals with pause items between, before and after them."""
    gaps = complement(items, by, on, off, F.lit(0.0), end).withColumnsRenamed({"on": on, "off": off}).withColumn(label, F.lit(pause))
    return items.select(*by, on, off, label).unionByName(gaps.select(*by, on, off, label))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose keys it doesn't have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def first_source(df: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Of rows for the same key, all rows of the first source that has it."""
    w = Window.partitionBy(*keys).orderBy(source)
    return df.withColumn("__r", F.rank().over(w)).where("__r = 1").drop("__r")


def sync_centers(spans: DataFrame, centers: DataFrame, by: list[str], on: str, off: str, t: str) -> DataFrame:
    """Keep a span only if it holds a centre that no earlier span has taken; each
    centre serves once.  One ordered fold per ``by`` group."""
    times = centers.groupBy(*by).agg(F.array_sort(F.collect_list(t)).alias("__ts"))
    listed = spans.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(on, off))).alias("__s"))
    none = F.struct(F.lit(-1e308).alias("last"), F.array().cast(f"array<struct<{on}:double,{off}:double>>").alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        hit = F.array_min(F.filter(F.col("__ts"), lambda x: (x > acc["last"]) & (x >= s[on]) & (x <= s[off])))
        taken = F.struct(hit.alias("last"), F.array_append(acc["kept"], F.struct(s[on].cast("double").alias(on), s[off].cast("double").alias(off))).alias("kept"))
        return F.when(hit.isNotNull(), taken).otherwise(acc)

    return listed.join(times, by).select(*by, F.explode(F.aggregate("__s", none, step)["kept"]).alias("__k")).select(*by, f"__k.{on}", f"__k.{off}")
