"""Scaling, centroids, distances and clustering of feature vectors."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import euclid, iqr, percentile
from ..storage import saved

#: The bandwidth of mean shift is estimated on so many vectors, by hash of their id.
BANDWIDTH_ROWS = 1000
#: Values of the modes that one pass over the rows takes.
PASS_VALUES = 400_000


def long_vectors(df: DataFrame, key: str, vector: str, keep: list[str] | None = None) -> DataFrame:
    """``key, keep, j, x``: one row per coordinate."""
    return df.select(key, *(keep or []), F.posexplode(vector).alias("j", "x")).withColumn("x", F.col("x").cast("double"))


def robust_scale(long: DataFrame) -> DataFrame:
    """Adds ``z``: distance from the column's median in interquartile ranges; a
    column without range is divided by 1."""
    s = long.groupBy("j").agg(F.median("x").alias("__m"), iqr("x").alias("__q"))
    z = (F.col("x") - F.col("__m")) / F.when(F.col("__q") == 0, 1.0).otherwise(F.col("__q"))
    return long.join(F.broadcast(s), "j").withColumn("z", z).drop("__m", "__q")


def centroids(long: DataFrame, label: str, x: str = "x") -> DataFrame:
    """``label, j, c``: medians per class and coordinate."""
    return long.groupBy(label, "j").agg(F.median(x).alias("c"))


def as_vectors(cells: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Coordinates back to one array per key."""
    return cells.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", F.col(value).alias("v")))), lambda s: s["v"]).alias(name))


def nearest_centroid(df: DataFrame, key: str, vector: str, cents: DataFrame, label: str, cent: str, weights: Column | None = None) -> DataFrame:
    """``key, class, dist``: the class of least distance, the smaller one of equal.

    Classes are few and are collected into one array beside each row, so a row is
    compared where it lies.
    """
    table = cents.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("class"), F.col(cent).alias("v")))).alias("__all"))
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    best = F.array_min(F.transform("__all", lambda c: F.struct(euclid(x, c["v"], weights).alias("dist"), c["class"].alias("class"))))
    return df.crossJoin(F.broadcast(table)).select(key, best.alias("__b")).select(key, "__b.class", "__b.dist")


def split_centroids(long: DataFrame, percent: float) -> DataFrame:
    """``j, low, high``: per column the medians of the values up to and above a percentile."""
    p = long.groupBy("j").agg(percentile("x", percent).alias("__p"))
    rows = long.join(F.broadcast(p), "j")
    return rows.groupBy("j").agg(F.median(F.when(F.col("x") <= F.col("__p"), F.col("x"))).alias("low"), F.median(F.when(F.col("x") > F.col("__p"), F.col("x"))).alias("high"))


def corr_weights(long: DataFrame, key: str) -> DataFrame:
    """``j, w``: correlation of each column with the row mean, not below 0, summing to 1."""
    rows = long.withColumn("__m", F.avg("x").over(Window.partitionBy(key)))
    c = rows.groupBy("j").agg(F.greatest(F.lit(0.0), F.coalesce(F.corr("x", "__m"), F.lit(0.0))).alias("__c"))
    total = F.broadcast(c.agg(F.sum("__c").alias("__t")))
    return c.crossJoin(total).select("j", F.when(F.col("__t") > 0, F.col("__c") / F.col("__t")).otherwise(0.0).alias("w"))


def delta(long: DataFrame, key: str) -> DataFrame:
    """Adds ``d``: difference from the row before; the first row's to the second."""
    w = Window.partitionBy("j").orderBy(key)
    return long.withColumn("d", F.coalesce(F.col("x") - F.lag("x").over(w), F.col("x") - F.lead("x").over(w)))


def enforce_distance(df: DataFrame, by: list[str], t: str, strength: str, least: float) -> DataFrame:
    """Keep points at least ``least`` apart: going through time, of two that are too
    near the stronger stays.  An ordered fold per group."""
    item = F.struct(F.col(t).cast("double").alias("t"), F.col(strength).cast("double").alias("s"))
    listed = df.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("__p"))
    start = F.array().cast("array<struct<t:double,s:double>>")

    def step(kept: Column, p: Column) -> Column:
        last = F.element_at(kept, -1)
        near = (F.size(kept) > 0) & (p["t"] - last["t"] < least)
        swapped = F.array_append(F.slice(kept, F.lit(1), F.size(kept) - 1), p)
        return F.when(~near, F.array_append(kept, p)).when(p["s"] > last["s"], swapped).otherwise(kept)

    return listed.select(*by, F.explode(F.aggregate("__p", start, step)).alias("__k")).select(*by, F.col("__k.t").alias(t), F.col("__k.s").alias(strength))


def kmeans(df: DataFrame, key: str, vector: str, start: list[list[float]], rounds: int = 300) -> DataFrame:
    """``key, class, dist`` after Lloyd rounds from given centres; a round is one
    aggregate, and only centres come to the driver.  Ends when no centre moves;
    centres that still move after all rounds are reported by a warning."""
    spark, now = df.sparkSession, [list(map(float, c)) for c in start]
    for _ in range(rounds):
        cents = spark.createDataFrame(list(enumerate(now)), "class int, v array<double>")
        placed = nearest_centroid(df, vector, vector, cents, "class", "v")
        means = placed.select("class", F.posexplode(vector).alias("j", "x")).groupBy("class", "j").agg(F.avg(F.col("x").cast("double")).alias("x"))
        new = {r["class"]: r["v"] for r in as_vectors(means, "class", "x", "v").collect()}
        after = [new.get(i, c) for i, c in enumerate(now)]
        moved = max(abs(a - b) for x, y in zip(after, now, strict=True) for a, b in zip(x, y, strict=True))
        now = after
        if moved < 1e-9:
            break
    else:
        warnings.warn(f"kmeans: centres still move by {moved:g} after {rounds} rounds", stacklevel=2)
    return nearest_centroid(df, key, vector, spark.createDataFrame(list(enumerate(now)), "class int, v array<double>"), "class", "v")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T))


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    return pa.chunked_array([c.flatten() for c in getattr(column, "chunks", [column])], pa.float64()).to_numpy().reshape(-1, d)


def _near(rows: DataFrame, modes: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """How many of the rows' vectors ``x`` lie within ``reach`` of each mode, and
    their sums.  Tasks sum before the shuffle: a task sends one row a mode."""
    d = modes.shape[1]
    count, total = np.zeros(len(modes), np.int64), np.zeros(modes.shape)

    def sums(part: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, own = np.zeros(len(part), np.int64), np.zeros(part.shape)
            for batch in batches:
                x = _matrix(batch.column(0), d)
                for i in range(0, len(x), 2048):
                    some = x[i : i + 2048]
                    for k in range(0, len(part), 1024):
                        inside = (_distance(part[k : k + 1024], some) <= reach).astype(float)
                        n[k : k + 1024] += inside.sum(1).astype(np.int64)
                        own[k : k + 1024] += inside @ some
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(n[hit]), pa.array(list(own[hit]), pa.list_(pa.float64()))], names=["m", "n", "x"])

        return run

    size = max(1, PASS_VALUES // max(1, d))
    for k in range(0, len(modes), size):
        found = rows.mapInArrow(sums(modes[k : k + size]), "m bigint, n bigint, x array<double>")
        got = found.groupBy("m").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("x")[j]) for j in range(d))).alias("x")).toArrow()
        at = got["m"].to_numpy() + k
        count[at], total[at] = got["n"].to_numpy(), _matrix(got["x"], d)
    return count, total


def mean_shift(df: DataFrame, key: str, vector: str, bandwidth: float | None = None, quantile: float = 0.3, rounds: int = 300) -> DataFrame:
    """``key, class, dist`` to modes found by a flat kernel: every vector starts a
    mode, modes move to the mean of all vectors within the bandwidth until they
    move by a thousandth of it, and of modes within a bandwidth the one with most
    vectors stays.

    Without a bandwidth it is the mean distance to the ``quantile`` nearest share
    of ``BANDWIDTH_ROWS`` vectors (least hashes of the id), or 0.5 if that is 0.

    A round is a pass over the rows and compares each with every mode that still
    moves; the first round's work is the square of the rows.  The distinct modes
    lie in the driver, modes that agree within rounding as one.
    """
    spark = df.sparkSession
    sample = np.array([r[0] for r in df.orderBy(F.xxhash64(key), key).limit(BANDWIDTH_ROWS).select(vector).collect()], dtype=float)
    if not len(sample):
        return spark.createDataFrame([], df.select(key, F.lit(0).alias("class"), F.lit(0.0).alias("dist")).schema)
    if bandwidth is None:
        near = max(1, math.floor(len(sample) * quantile))
        bandwidth = float(np.sort(_distance(sample, sample), axis=1)[:, near - 1].mean()) or 0.5
    rows = saved(df.select(F.col(vector).cast("array<double>").alias("x")).repartition(spark.sparkContext.defaultParallelism), "vectors")
    modes = _matrix(rows.distinct().toArrow()["x"], sample.shape[1])
    still: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        count, total = _near(rows, modes, bandwidth)
        new = np.where(count[:, None] > 0, total / np.maximum(1, count)[:, None], modes)
        stops = np.linalg.norm(new - modes, axis=1) <= 1e-3 * bandwidth
        still.append((count[stops], new[stops]))
        modes = new[~stops]
        modes = modes[np.unique(np.round(modes / (1e-9 * bandwidth)), axis=0, return_index=True)[1]]
        if not len(modes):
            break
    else:
        warnings.warn(f"mean_shift: {len(modes)} modes still move after {rounds} rounds", stacklevel=2)
        still.append((_near(rows, modes, bandwidth)[0], modes))
    weight, modes = (np.concatenate(x) for x in zip(*still, strict=True))
    # A mode that left all vectors is none.
    if weight.any():
        weight, modes = weight[weight > 0], modes[weight > 0]
    order = np.lexsort([*modes.T[::-1], weight])[::-1]
    modes, left, kept = modes[order], np.ones(len(order), bool), []
    while left.any():
        i = int(left.argmax())
        kept.append(modes[i])
        left &= _distance(modes[i : i + 1], modes)[0] > bandwidth
        left[i] = False
    cents = spark.createDataFrame([(j, m.tolist()) for j, m in enumerate(kept)], "class int, v array<double>")
    return nearest_centroid(df, key, vector, cents, "class", "v")


def silhouette(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``key, silhouette`` with squared distances, from sums per cluster: a row needs
    no other row, only each cluster's size, mean and mean square."""
    cells = long_vectors(df, key, vector, [label])
    per = cells.groupBy(label, "j").agg(F.avg("x").alias("v"), F.avg(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    clusters = per.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("v"), F.sum("q").alias("q"), F.max("n").alias("n"))
    table = clusters.agg(F.collect_list(F.struct(F.col(label).alias("l"), "v", "q", "n")).alias("__all"))
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    mean_to = lambda c: dot(x, x) - 2 * dot(x, c["v"]) + c["q"]
    rows = df.crossJoin(F.broadcast(table))
    own = F.element_at(F.filter("__all", lambda c: c["l"] == F.col(label)), 1)
    a = mean_to(own) * own["n"] / (own["n"] - 1)
    b = F.array_min(F.transform(F.filter("__all", lambda c: c["l"] != F.col(label)), mean_to))
    value = F.when(own["n"] <= 1, 0.0).otherwise((b - a) / F.greatest(a, b))
    return rows.select(key, value.alias("silhouette"))
