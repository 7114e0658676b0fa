"""Boundary and accent candidates: features, seeds, centroids, classes, selection.

A candidate is a row with the columns ``by`` of its recording, a time ``t`` that is
unique there, features ``v`` (an array) and, if it is certain, its class ``seed``.
``unit`` names the columns of the rows that are scaled and classified together: the
recording's, or none for the whole corpus.  A unit's centres and weights are one
row of short arrays, so a candidate meets a single row of another table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import euclid, fused_percentile, iqr, nonzero, percentile
from ..storage import saved
from .interval import asof_previous, range_join

#: Up to so many rows a unit is scaled by its largest magnitudes.
SPARSE = 10

#: Sums of scaled magnitudes that near to a limit lie on it.
ON_LIMIT = 1e-12


# --- features ----------------------------------------------------------------
def feature_vector(df: DataFrame, weights: dict[str, float], magnitude: set[str] = frozenset()) -> tuple[DataFrame, list[float]]:
    """Adds ``v``, the columns of positive weight in order of name, those in
    ``magnitude`` without sign, and ``bad``: whether one of them was null or not a
    finite number, which counts as 0.  Also gives the weights of ``v``."""
    names = sorted(n for n, w in weights.items() if w > 0)
    cells = [F.abs(F.col(n).cast("double")) if n in magnitude else F.col(n).cast("double") for n in names]
    fine = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in cells]
    bad = F.lit(False)
    for ok in fine:
        bad = bad | ~F.coalesce(ok, F.lit(False))
    v = F.array(*(F.when(ok, c).otherwise(0.0) for ok, c in zip(fine, cells, strict=True)))
    return df.withColumn("v", v).withColumn("bad", bad), [float(weights[n]) for n in names]


def with_delta(df: DataFrame, by: list[str], measure: str, weights: list[float] | None = None) -> tuple[DataFrame, list[float] | None]:
    """``v`` as it is (``abs``), its difference from the candidate before (``delta``;
    the first one's to the second), or both in a row, with the weights repeated."""
    if measure == "abs":
        return df, weights
    w = Window.partitionBy(*by).orderBy("t")
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    d = F.coalesce(minus(F.col("v"), F.lag("v").over(w)), minus(F.col("v"), F.lead("v").over(w)), F.transform("v", lambda x: x * 0.0))
    if measure == "delta":
        return df.withColumn("v", d), weights
    return df.withColumn("__d", d).withColumn("v", F.concat("v", "__d")).drop("__d"), weights and weights * 2


def previous_vowel(candidates: DataFrame, phones: DataFrame, by: list[str], vowels: str) -> DataFrame:
    """Adds ``vowel`` and ``vowel_dur`` of the last phone (``on, off, label``) that
    begins before ``t`` and whose label has the pattern; ``x`` and 1 without one."""
    spoken = phones.where(F.col("label").rlike(vowels)).select(*by, F.col("on").alias("t"), F.struct("label", (F.col("off") - F.col("on")).alias("dur")).alias("__p"))
    rows = asof_previous(candidates, spoken, by, "t", "__p")
    return rows.withColumn("vowel", F.coalesce("previous.label", F.lit("x"))).withColumn("vowel_dur", F.coalesce("previous.dur", F.lit(1.0))).drop("previous")


def vowel_scaled(df: DataFrame, unit: list[str]) -> DataFrame:
    """``vowel_dur`` as distance from the median of its vowel in interquartile ranges."""
    s = df.groupBy(*unit, "vowel").agg(F.median("vowel_dur").alias("__m"), iqr("vowel_dur").alias("__q"))
    z = (F.col("vowel_dur") - F.col("__m")) / F.when(F.col("__q") == 0, 1.0).otherwise(F.col("__q"))
    return df.join(s, [*unit, "vowel"]).withColumn("vowel_dur", z).drop("__m", "__q")


# --- seeds -------------------------------------------------------------------
def gap_seeds(segments: DataFrame, by: list[str], shortest: float | None = None, gap: float = 0.0) -> DataFrame:
    """Segments that another follows, with ``t`` their end and ``seed`` 1 where the
    next begins more than ``gap`` later; 0 after one shorter than ``shortest``."""
    w = Window.partitionBy(*by).orderBy("on")
    rows = segments.withColumn("__next", F.lead("on").over(w)).where("__next IS NOT NULL").withColumn("t", F.col("off"))
    seed = F.when(F.col("off") < F.col("__next") - gap, 1)
    if shortest is not None:
        seed = seed.when(F.col("off") - F.col("on") < shortest, 0)
    return rows.withColumn("seed", seed.cast("int")).drop("__next")


def near_seeds(df: DataFrame, by: list[str], least: float, both: bool = False) -> DataFrame:
    """Seeds class 0 less than ``least`` before a seed of class 1 (``both``: or after)."""
    w, one = Window.partitionBy(*by).orderBy("t"), F.when(F.col("seed") == 1, F.col("t"))
    near = F.first(one, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)) - F.col("t") < least
    if both:
        near = near | F.coalesce(F.col("t") - F.last(one, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) < least, F.lit(False))
    return df.withColumn("__near", F.coalesce(near, F.lit(False))).withColumn("seed", F.when(F.col("seed") == 1, 1).when(F.col("__near"), 0).otherwise(F.col("seed"))).drop("__near")


def minmax_seeds(df: DataFrame, unit: list[str], low: float = 10.0, high: float = 90.0) -> DataFrame:
    """Seeds by the sum of a row's scaled magnitudes: 0 up to a low percentile of
    it, 1 from a high one on; a sum that rounding alone keeps from a limit is on it."""
    rows = scaled(df.withColumn("__v", F.transform("v", F.abs)), unit, "__v", few=0).withColumn("__s", _total("__v"))
    rows, key = _keyed(rows, unit)
    limits = rows.groupBy(*key).agg(percentile("__s", low).alias("__lo"), percentile("__s", high).alias("__hi"))
    rows = rows.join(limits, key)
    one, zero = F.col("__s") >= F.col("__hi") - ON_LIMIT, F.col("__s") <= F.col("__lo") + ON_LIMIT
    return rows.withColumn("seed", F.when(one, 1).when(zero, 0)).drop("__v", "__s", "__lo", "__hi", "__unit")


def word_seeds(df: DataFrame, words: DataFrame, by: list[str], weights: list[float], longest_0: float, shortest_1: float) -> DataFrame:
    """Seeds from word lengths: 0 for candidates in words (``on, off``) up to
    ``longest_0``, 1 for the one of greatest weighted mean in words of ``shortest_1``
    and more; a candidate that is both is 1."""
    length = F.round(F.col("off") - F.col("on"), 9)
    kind = words.withColumn("__k", F.when(length <= longest_0, 0).when(length >= shortest_1, 1)).where("__k IS NOT NULL")
    held = range_join(df.select(*by, "t", weighted_mean(F.col("v"), weights).alias("__w")), kind.select(*by, "on", "off", "__k"), by, "t", "on", "off", 1.0, "inner")
    best = held.where("__k = 1").groupBy(*by, "on", "off").agg(F.max_by("t", F.struct("__w", -F.col("t"))).alias("t"))
    found = held.where("__k = 0").select(*by, "t", F.lit(0).alias("__s")).unionByName(best.select(*by, "t", F.lit(1).alias("__s")))
    return df.drop("seed").join(found.groupBy(*by, "t").agg(F.max("__s").alias("seed")), [*by, "t"], "left")


def drop_bad_seeds(df: DataFrame, by: list[str], measure: str = "abs") -> DataFrame:
    """No seed of class 1 from features that were missing, or, with differences,
    whose predecessor's were."""
    bad = F.col("bad")
    if "delta" in measure:
        bad = bad | F.coalesce(F.lag("bad").over(Window.partitionBy(*by).orderBy("t")), F.lit(False))
    return df.withColumn("__bad", bad).withColumn("seed", F.when((F.col("seed") == 1) & F.col("__bad"), None).otherwise(F.col("seed"))).drop("__bad")


# --- scaling, centroids, weights -----------------------------------------------
def _keyed(df: DataFrame, unit: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, unit) if unit else (df.withColumn("__unit", F.lit(0)), ["__unit"])


def _total(v: str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def weighted_mean(v: Column, weights: Column | list[float]) -> Column:
    w = F.array(*map(F.lit, weights)) if isinstance(weights, list) else weights
    return F.aggregate(F.zip_with(v, w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / F.aggregate(w, F.lit(0.0), lambda s, x: s + x)


def by_column(df: DataFrame, key: list[str], v: str = "v", keep: tuple[str, ...] = (), **aggregates: Column) -> DataFrame:
    """Aggregates over each place ``x`` of the arrays, one array per name and unit."""
    long = df.select(*key, *keep, F.posexplode(v).alias("j", "x"))
    cells = long.groupBy(*key, "j").agg(*(c.alias(n) for n, c in aggregates.items()))
    row = F.array_sort(F.collect_list(F.struct("j", *aggregates)))
    field = lambda n: F.transform("__r", lambda c: c[n]).alias(n)
    return cells.groupBy(*key).agg(row.alias("__r")).select(*key, *map(field, aggregates))


def scaled(df: DataFrame, unit: list[str], v: str = "v", few: int = SPARSE) -> DataFrame:
    """``v`` over its largest magnitude in units of up to ``few`` rows, else as distance
    from the median in interquartile ranges; a scale of 0 counts as 1."""
    rows, key = _keyed(df, unit)
    sparse = F.count(F.lit(1)) <= few
    center, scale = F.when(sparse, 0.0).otherwise(F.median("x")), F.when(sparse, F.max(F.abs("x"))).otherwise(iqr("x"))
    stats = by_column(rows, key, v, __c=center, __q=F.when(scale == 0, 1.0).otherwise(scale))
    z = F.zip_with(F.zip_with(v, "__c", lambda x, c: x - c), "__q", lambda x, q: x / q)
    return rows.join(stats, key).withColumn(v, z).drop("__c", "__q", "__unit")


def silhouette_weights(df: DataFrame, unit: list[str], label: str = "class") -> DataFrame:
    """``unit, w`` (``__unit`` for no unit): per feature 1 plus the mean silhouette of the two classes in it
    alone, summing to 1; 1 each for a unit of one class.

    Distances on a line need no pairs: a row's sum of distances to a class follows
    from the counts and sums of the class's values below it.
    """
    rows, key = _keyed(df, unit)
    long = rows.select(*key, F.col(label).alias("__l"), F.posexplode("v").alias("j", "x"))
    part = Window.partitionBy(*key, "j")
    upto = part.orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    for k in (0, 1):
        own = F.col("__l") == k
        n, s = F.sum(own.cast("int")), F.sum(F.when(own, F.col("x")).otherwise(0.0))
        n_le, s_le = n.over(upto), s.over(upto)
        long = long.withColumn(f"__n{k}", n.over(part)).withColumn(f"__d{k}", F.col("x") * n_le - s_le + s.over(part) - s_le - F.col("x") * (F.col(f"__n{k}") - n_le))
    pick = lambda c, own: F.when((F.col("__l") == 0) == own, F.col(f"__{c}0")).otherwise(F.col(f"__{c}1"))
    yes, no = F.lit(True), F.lit(False)
    a, b = pick("d", yes) / (pick("n", yes) - 1), pick("d", no) / pick("n", no)
    top = F.greatest(a, b)
    s = F.when(pick("n", yes) <= 1, 0.0).when(top > 0, (b - a) / top).otherwise(0.0)
    one = F.min("__l") == F.max("__l")
    cells = long.withColumn("__s", s).groupBy(*key, "j").agg(F.when(one, 1.0).otherwise(F.avg("__s") + 1).alias("w"), one.alias("one"))
    out = cells.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "w"))), lambda c: c["w"]).alias("w"), F.first("one").alias("one"))
    total = _total("w")
    return out.withColumn("w", F.when(F.col("one"), F.col("w")).otherwise(F.transform("w", lambda x: x / total))).drop("one")


def correlation_weights(df: DataFrame, unit: list[str]) -> DataFrame:
    """``unit, w`` (``__unit`` for no unit): correlation of each feature with the row mean, not below 0,
    summing to 1; 1 each where none is positive."""
    rows, key = _keyed(df, unit)
    rows = rows.withColumn("__m", _total("v") / F.size("v"))
    corr = F.corr("x", "__m")
    got = by_column(rows, key, keep=("__m",), w=F.when((F.min("x") == F.max("x")) | (F.min("__m") == F.max("__m")), 0.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(F.nanvl(corr, F.lit(0.0)), F.lit(0.0)))))
    total = _total("w")
    return got.withColumn("w", F.when(total > 0, F.transform("w", lambda x: x / total)).otherwise(F.transform("w", lambda x: x * 0 + 1.0)))


def split_medians(df: DataFrame, key: list[str], percent: float) -> DataFrame:
    """``key, c0, c1``: per feature the medians of the values up to and above a
    percentile, or the mean if none is above it; of equal values the median of all."""
    limit = percentile("x", percent)
    limits = by_column(df, key, __p=F.when(F.max("x") > limit, limit).otherwise(F.avg("x")))
    pairs = df.join(limits, key).withColumn("__x", F.arrays_zip(F.col("v").alias("x"), F.col("__p").alias("p")))
    low, high = F.col("x.x") <= F.col("x.p"), F.col("x.x") > F.col("x.p")
    part = lambda cond: F.coalesce(F.median(F.when(cond, F.col("x.x"))), F.median(F.col("x.x")))
    return by_column(pairs, key, "__x", c0=part(low), c1=part(high))


def centroids(df: DataFrame, unit: list[str], method: str, percent: float, weighting: str, user: list[float], flipped: bool = False) -> DataFrame:
    """``unit, c0, c1, w``: the classes' centres among scaled rows, and weights.

    ``split``, and any method in a unit without seeds of class 1: medians below and
    above a percentile, feature by feature.  ``seed_wgt``: medians of the seeds.
    ``seed_prct``, and the others in a unit with seeds of one class only: medians of
    the rows whose distance from seed 0 over that from seed 1 is up to a percentile
    and above.  ``seed_kmeans``: the seeds' medians after Lloyd rounds, see
    :func:`two_means`.  With one seed class a row nearer to seed 1 counts as class 1;
    ``flipped`` puts it the other way round.

    ``weighting``: ``silhouette`` (of the classes that the first centres make),
    ``corr``, or the ``user``'s weights, which also stand in a unit of up to two rows.
    """
    rows, key = _keyed(df, unit)
    first = by_column(rows, key, keep=("seed",), s0=F.median(F.when(F.col("seed") == 0, F.col("x"))), s1=F.median(F.when(F.col("seed") == 1, F.col("x"))), n=F.count(F.lit(1)))
    first = first.join(split_medians(rows, key, percent), key)
    has0, has1 = F.element_at("s0", 1).isNotNull(), F.element_at("s1", 1).isNotNull()
    seeded = has1 if method.startswith("seed") else F.lit(False)
    given = F.array(*map(F.lit, user))
    few = F.element_at("n", 1) <= 2
    start0, start1 = F.when(seeded, F.col("s0")).otherwise(F.col("c0")), F.when(seeded, F.col("s1")).otherwise(F.col("c1"))
    first = first.select(*key, start0.alias("a0"), start1.alias("a1"), has0.alias("has0"), seeded.alias("seeded"), few.alias("few"), "c0", "c1")
    if weighting == "corr":
        w = correlation_weights(rows, key)
    elif weighting == "silhouette":
        near = rows.join(first, key).where("a0 IS NOT NULL AND a0[0] IS NOT NULL").withColumn("class", (euclid(F.col("v"), F.col("a1")) < euclid(F.col("v"), F.col("a0"))).cast("int"))
        w = silhouette_weights(near, key)
    else:
        w = first.select(*key, given.alias("w"))
    first = saved(first.join(w, key, "left"), "first-centres").withColumn("w", F.when(F.col("few") | F.col("w").isNull(), given).otherwise(F.col("w"))).drop("few")
    if method == "split":
        return first.select(*unit, "c0", "c1", "w")
    both = F.col("seeded") & F.col("has0")
    d0, d1 = euclid(F.col("v"), F.col("a0"), F.col("w")), euclid(F.col("v"), F.col("a1"), F.col("w"))
    # The higher, the nearer to class 1.
    alone = d1 if flipped else -d1
    ratio = rows.join(first, key).withColumn("__d", F.when(both, d0 / nonzero(d1)).otherwise(alone))
    # Rows of equal distance may differ in its last digit and have the limit between them.
    limit = ratio.groupBy(*key).agg(F.sort_array(F.collect_list("__d")).alias("__p"), F.avg("__d").alias("__m"), F.max("__d").alias("__top"))
    limit = limit.withColumn("__p", fused_percentile(F.col("__p"), percent))
    above = F.col("__d") > F.when(F.col("__top") > F.col("__p"), F.col("__p")).otherwise(F.col("__m"))
    halves = by_column(ratio.join(limit, key).withColumn("__h", above), key, keep=("__h",), h0=F.coalesce(F.median(F.when(~F.col("__h"), F.col("x"))), F.median("x")), h1=F.coalesce(F.median(F.when(F.col("__h"), F.col("x"))), F.median("x")))
    out = first.join(halves, key, "left")
    keep_seeds = both if method in ("seed_wgt", "seed_kmeans") else F.lit(False)
    pick = lambda a, h, c: F.when(~F.col("seeded"), F.col(c)).when(keep_seeds, F.col(a)).otherwise(F.col(h))
    out = out.select(*key, pick("a0", "h0", "c0").alias("c0"), pick("a1", "h1", "c1").alias("c1"), "w", (F.col("seeded") & F.col("has0")).alias("__both"))
    if method == "seed_kmeans":
        out = two_means(rows, out, key)
    return out.drop("__both", *([] if unit else ["__unit"]))


def two_means(rows: DataFrame, start: DataFrame, key: list[str], rounds: int = 300) -> DataFrame:
    """``c0, c1`` after Lloyd rounds in every unit at once, where both seeds exist."""
    now = start
    for _ in range(rounds):
        placed = rows.join(now.where("__both"), key).withColumn("__k", (euclid(F.col("v"), F.col("c1")) < euclid(F.col("v"), F.col("c0"))).cast("int"))
        means = by_column(placed, key, keep=("__k",), n0=F.avg(F.when(F.col("__k") == 0, F.col("x"))), n1=F.avg(F.when(F.col("__k") == 1, F.col("x"))))
        new = now.join(means, key, "left")
        moved = lambda k: F.when(F.col(f"n{k}").isNull() | F.element_at(f"n{k}", 1).isNull(), F.col(f"c{k}")).otherwise(F.col(f"n{k}"))
        after = new.withColumn("__moves", ~(moved(0).eqNullSafe(F.col("c0")) & moved(1).eqNullSafe(F.col("c1")))).withColumn("c0", moved(0)).withColumn("c1", moved(1)).drop("n0", "n1")
        after = saved(after, "centres")
        still = after.where("__moves").isEmpty()
        now = after.drop("__moves")
        if still:
            break
    return now


# --- classes -----------------------------------------------------------------
def classify(df: DataFrame, unit: list[str], centers: DataFrame, attract: tuple[float, float] | None = None) -> DataFrame:
    """Adds ``class`` and ``weight`` (the weighted mean of ``v``): the nearer centre by
    weighted distance, 0 of equal ones; ``attract`` shortens the distance to a class
    by its share.  A seed of class 1 stays 1."""
    rows, key = _keyed(df, unit)
    centers = centers if unit else centers.withColumn("__unit", F.lit(0))
    rows = rows.join(centers, key)
    d = [euclid(F.col("v"), F.col(f"c{k}"), F.col("w")) for k in (0, 1)]
    if attract:
        d = [x * (1 - a / sum(attract)) for x, a in zip(d, attract, strict=True)]
    one = (d[1] < d[0]) | F.coalesce(F.col("seed") == 1, F.lit(False))
    return rows.withColumn("class", one.cast("int")).withColumn("weight", weighted_mean(F.col("v"), F.col("w"))).drop("c0", "c1", "w", "__unit")


def keep_apart(df: DataFrame, by: list[str], least: float) -> DataFrame:
    """``class`` 1 only ``least`` apart: going through time, each looks back over those
    nearer than that; of two the seed stays, else that of more ``weight``, the earlier
    of equal ones.  Two seeds both stay.  One recording is one ordered pass."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t", kind="stable").reset_index(drop=True)
        t, c, weight, sure = frame["t"].tolist(), frame["class"].tolist(), frame["weight"].tolist(), (frame["seed"] == 1).tolist()
        ones: list[int] = []
        for i, k in enumerate(c):
            if not k:
                continue
            while ones and c[i]:
                j = ones[-1]
                if t[i] - t[j] >= least or (sure[i] and sure[j]):
                    break
                if sure[j] or (not sure[i] and weight[j] >= weight[i]):
                    c[i] = 0
                else:
                    c[j] = 0
                    ones.pop()
            if c[i]:
                ones.append(i)
        frame["class"] = c
        return frame

    return df.groupBy(*by).applyInPandas(run, df.schema)


def classified(df: DataFrame, by: list[str], unit: list[str], weights: list[float], conf: dict) -> DataFrame:
    """Candidates (``t, v, bad, seed``) with their ``class``, by the settings of one kind:
    ``measure, cntr_mtd, prct, wgt_mtd, min_l``."""
    rows, weights = with_delta(df, by, conf["measure"], weights)
    # Written, for its plan would come again in each of the aggregates over it.
    rows = saved(scaled(drop_bad_seeds(rows, by, conf["measure"]), unit), "scaled")
    centers = centroids(rows, unit, conf["cntr_mtd"], conf["prct"], conf["wgt_mtd"], weights)
    attract = (conf["prct"], 100 - conf["prct"]) if conf["cntr_mtd"] == "seed_wgt" else None
    return keep_apart(classify(rows, unit, centers, attract), by, conf["min_l"])


# --- from classes to tiers -------------------------------------------------------
def cut_segments(segments: DataFrame, marked: DataFrame, parents: DataFrame, by: list[str], least: float) -> DataFrame:
    """``by, on, off``: segments joined between cuts.

    A cut is a segment's end that ``marked`` has with ``class`` 1, or that is the end
    of a parent.  After the last cut comes the rest up to the last parent's end, or
    that cut's segment is extended to it if the rest is shorter than ``least``.
    Without a cut all is one segment, from the first parent to the last.
    """
    ends = parents.groupBy(*by).agg(F.min("on").alias("__first"), F.max("off").alias("__end"))
    cuts = marked.where("class = 1").select(*by, F.col("t").alias("off")).unionByName(parents.select(*by, "off")).distinct().withColumn("cut", F.lit(1))
    w = Window.partitionBy(*by).orderBy("on", "off")
    rows = segments.select(*by, "on", "off").join(cuts, [*by, "off"], "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    # The last segment's end is where the recording ends, not a boundary in it.
    rows = rows.withColumn("cut", F.when(F.lead("on").over(w).isNull(), 0).otherwise(F.col("cut")))
    run = F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cut")
    parts = rows.withColumn("run", run).groupBy(*by, "run").agg(F.min("on").alias("on"), F.max("off").alias("off"), F.max("cut").alias("cut"))
    parts = parts.where("cut = 1").select(*by, "on", "off")
    last = parts.groupBy(*by).agg(F.max("off").alias("__last"))
    tail = ends.join(last, by, "left")
    short = F.col("__end") - F.col("__last") < least
    extended = parts.join(tail, by).withColumn("off", F.when((F.col("off") == F.col("__last")) & (F.col("__end") > F.col("__last")) & short, F.col("__end")).otherwise(F.col("off")))
    rest = tail.where(F.col("__last").isNull() | ((F.col("__end") > F.col("__last")) & ~short)).select(*by, F.coalesce("__last", "__first").alias("on"), F.col("__end").alias("off"))
    return extended.select(*by, "on", "off").unionByName(rest)


def preselect(points: DataFrame, groups: DataFrame, by: list[str], how: str) -> DataFrame:
    """The ``left`` or ``right`` point of each group (``on, off``); with another choice,
    or for no group at all, every point.  A point that two groups choose comes once."""
    if how not in ("left", "right"):
        return points
    held = range_join(points.select(*by, "t"), groups.select(*by, "on", "off"), by, "t", "on", "off", 1.0, "inner")
    pick = (F.min if how == "left" else F.max)("t").alias("t")
    chosen = held.groupBy(*by, "on", "off").agg(pick).select(*by, "t").distinct()
    none = points.join(groups.select(*by).distinct(), by, "left_anti")
    return points.join(chosen, [*by, "t"], "left_semi").unionByName(none)


def postselect(accents: DataFrame, groups: DataFrame, by: list[str], score: str = "weight", smallest: bool = False) -> DataFrame:
    """One of a group's accents: of greatest ``score`` (or ``smallest``, as for a distance
    to a centre), the earliest of equal ones; those outside all groups go."""
    held = range_join(accents.select(*by, "t", score), groups.select(*by, "on", "off"), by, "t", "on", "off", 1.0, "inner")
    value = -F.col(score) if smallest else F.col(score)
    chosen = held.groupBy(*by, "on", "off").agg(F.max_by("t", F.struct(value, -F.col("t"))).alias("t"))
    return accents.join(chosen.select(*by, "t").distinct(), [*by, "t"], "left_semi")


def forced(points: DataFrame, energy: DataFrame, by: list[str]) -> DataFrame:
    """``by, t``: the points, and for a recording without any the time of its greatest
    energy (``t, y``), the earliest of equal ones."""
    top = energy.groupBy(*by).agg(F.max_by("t", F.struct("y", -F.col("t"))).alias("t"))
    return points.select(*by, "t").unionByName(top.join(points.select(*by).distinct(), by, "left_anti").select(*by, "t"))


def as_tier(rows: DataFrame, by: list[str], name: str, label: str, ends: DataFrame) -> DataFrame:
    """Segments (``on, off``) or points (``t``) as items of a tier ``<name>``, with the
    recording's end (``by, file_end``); segments get pauses between them."""
    if "t" in rows.columns:
        items = rows.select(*by, F.lit(name).alias("tier"), F.lit("TextTier").alias("class"), F.col("t").alias("xmin"), F.col("t").alias("xmax"), F.lit(label).alias("label"))
    else:
        items = rows.select(*by, F.lit(name).alias("tier"), F.lit("IntervalTier").alias("class"), F.col("on").alias("xmin"), F.col("off").alias("xmax"), F.lit(label).alias("label"))
    w = Window.partitionBy(*by).orderBy("xmin")
    return items.withColumn("item_idx", F.row_number().over(w)).join(ends.select(*by, "file_end"), by)


def add_tiers(items: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """``items`` with the tiers of ``new``, which take the place of those of their name."""
    names = new.select(*by, "tier").distinct()
    return items.join(names, [*by, "tier"], "left_anti").unionByName(new, allowMissingColumns=True)
