"""Mixing sources to target weights by cube-method balanced sampling.

Every document has an expected number of copies, its source's target over its
source's size.  The whole part is taken; the fractional parts are inclusion
probabilities that a flight phase moves through the null space of two balancing
constraints, documents and words, until all but a few units of a bucket are 0 or
1.  The units left over from all buckets fly again, level by level, until one
bucket is left for each source; its flight ends at 14 units at most, which a landing
step decides by trying all their outcomes.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, numbered_repeats, shuffle_partitions, table, work_dir, written

WORDS = r"[^\x20\x09-\x0D]+"
_EPS = 1e-9
#: Units that landing decides at most, by all their outcomes.
LANDED = 14
#: Units that move together in a step of the flight.
WINDOW = 256
#: Sources whose totals are broadcast; with more of them they are joined by shuffle.
BROADCAST_SOURCES = 100_000


def target_sizes(sizes: dict, weights: dict, share: float, most: float) -> dict:
    """Targets by weight over ``share`` of all sizes, none above ``most`` times
    its source's size; what is above is dealt again by weight to the others.

    ``sizes`` has one number per source, which the driver holds.
    """
    left, rest, target = share * sum(sizes.values()), set(sizes), {}
    while rest:
        total = sum(weights[s] for s in rest)
        over = {s for s in rest if left * weights[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weights[s] / total for s in rest}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        rest -= over
    return target


def fly(p: np.ndarray, size: np.ndarray, rng: random.Random) -> bool:
    """One step of the flight: move the probabilities ``p``, all between 0 and 1,
    along a direction that keeps sum(p) and sum(p * size), until one of them is 0
    or 1.  The direction is the first unit's, projected on the constraints' null
    space, or if that is nothing but 0 the next unit's that has one; False if none
    has."""
    mean = size.mean()
    apart = (size - mean) / max(mean, 1.0)  # the constraints, made orthogonal
    spread = apart @ apart
    flat = spread < _EPS
    own = 1 - 1 / len(p) - (0.0 if flat else apart * apart / spread) + np.zeros(len(p))
    lead = 0 if own[0] >= 1e-6 else int(own.argmax())
    if own[lead] < 1e-6:
        return False
    u = np.full(len(p), -1 / len(p)) if flat else -1 / len(p) - apart * (apart[lead] / spread)
    u[lead] += 1
    u[np.abs(u) < _EPS] = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        up, down = (1 - p) / np.abs(u), p / np.abs(u)
    ahead = np.where(u > 0, up, down)[u != 0].min()
    back = np.where(u > 0, down, up)[u != 0].min()
    step = ahead if rng.random() * (ahead + back) < back else -back
    p += step * u
    p[p < _EPS], p[p > 1 - _EPS] = 0.0, 1.0
    return True


def land(units: list[list], rng: random.Random) -> None:
    """Decide the last units, ``LANDED`` at most, together.

    Of all outcomes whose number is within one of the expected, those count whose
    words are nearest to the expected, within the smallest unit's size; one of them
    is drawn with its probability if all units were drawn independently.
    """
    if not units:
        return
    p, size = np.array([x[0] for x in units]), np.array([x[1] for x in units], dtype=float)
    bits = (np.arange(1 << len(units))[:, None] >> np.arange(len(units))) & 1
    bits = bits[np.abs(bits.sum(1) - p.sum()) <= 1]
    miss = np.abs(bits @ size - p @ size)
    bits = bits[miss <= miss.min() + size.min() + _EPS]
    chance = np.where(bits == 1, p, 1 - p).prod(1)
    total = np.cumsum(chance)
    chosen = int(np.searchsorted(total, rng.random() * total[-1])) if total[-1] > 0 else int(chance.argmax())
    for x, v in zip(units, bits[min(chosen, len(bits) - 1)], strict=True):
        x[0] = int(v)


def settle_heavy(p: np.ndarray, size: np.ndarray, rng: random.Random) -> None:
    """Decide each unit that is so far larger than the smaller ones that these can't
    make up for its words and keep their number: by one long step in the null space
    of the words alone, in which all of them move by their room.  Where they have
    room for one outcome only, that one it is.  Sizes fall."""
    i = 0
    while i < len(p) - 1 and size[i] > 4 * size[i + 1 :].mean() and size[i] > 0.5 * size[i + 1 :].std() * (len(p) - i - 1):
        rest = slice(i + 1, None)
        down, up = p[rest] @ size[rest], (1 - p[rest]) @ size[rest]
        more, less = (1 - p[i]) * size[i], p[i] * size[i]
        take = rng.random() < p[i]
        if more > down or less > up:
            take = more - down < less - up
        moved = min(1.0, more / down) if take else min(1.0, less / up)
        p[rest] += -moved * p[rest] if take else moved * (1 - p[rest])
        p[i] = float(take)
        i += 1
    p[p < _EPS], p[p > 1 - _EPS] = 0.0, 1.0


def fly_all(units: list[list], rng: random.Random, leave: int = LANDED) -> list[list]:
    """Fly ``units`` (``[p, size, ...]``) until ``leave`` at most, and no more than six
    or a third of them, are between 0 and 1.  Gives those.

    Units that outweigh the others are settled first.  The largest unit leads, and up to ``WINDOW`` of the next sizes move with it, so
    that the large are decided while many can make up for them and the open ones
    are of the smallest.
    """
    units = sorted(units, key=lambda x: -x[1])
    leave = min(leave, max(6, len(units) // 3))
    size = np.array([x[1] for x in units], dtype=float)
    p = np.array([x[0] for x in units], dtype=float)
    settle_heavy(p, size, rng)
    flying = np.flatnonzero((p > 0) & (p < 1))
    at, following = flying[:WINDOW], WINDOW
    while len(at) + max(0, len(flying) - following) > leave or (len(at) == 2 and size[at[0]] == size[at[1]]):
        now = p[at]
        if not fly(now, size[at], rng):
            break
        p[at] = now
        at = at[(now > 0) & (now < 1)]
        more = max(0, min(WINDOW - len(at), len(flying) - following))
        at = np.concatenate([at, flying[following : following + more]])
        following += more
    for x, v in zip(units, p.tolist(), strict=True):
        x[0] = v
    return [units[i] for i in [*at.tolist(), *flying[following:].tolist()]]


def _flight(names: list[str], seed: int, last: bool):
    """Fly over rows sorted by source and bucket, one bucket in memory at a time; the
    last bucket of a source ends with the landing."""
    key, p, n = names.index("__bucket"), names.index("__p"), names.index("size")
    sid = names.index("__sid")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, rng, out = None, [], random.Random(seed), []

        def give(units: list[list]) -> None:
            for x in units:
                x[2][p] = float(x[0])
                out.append(x[2])

        def close() -> None:
            still = fly_all(held, rng)
            if last:
                land(still, rng)
            give(held)
            held.clear()

        for frame in frames:
            for row in frame.astype(object).where(frame.notna(), None).values.tolist():
                if (now := (row[sid], row[key])) != at:
                    close()
                    at, rng = now, random.Random(f"{seed}/{now}")
                if not 0 < row[p] < 1:
                    out.append(row)
                    continue
                held.append([row[p], row[n], row])
            if out:
                yield pd.DataFrame(out, columns=names)
                out.clear()
        close()
        if out:
            yield pd.DataFrame(out, columns=names)
        out.clear()
        give_back()

    return run


def mix(docs: DataFrame, weights: dict | list, share: float = 1.5, most: float = 2.0, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 20, bucket_rows: int = 5000, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``doc_id, source, size, source_size, target, taken`` and those of
    ``keep`` for each row.

    ``weights``: a weight per source, or a list dealt in turn to the sources in
    code-point order, null last.  Size is the number of words of the whole text,
    however long; null text has 0.  ``taken`` is size times the copies taken, never
    above ``most`` rounded up.

    Null sources form a source of their own; a source of size 0 has target 0 and
    its rows take 0.  Repeated rows and null ids are units like any other: units
    are ordered by a hash of what is read and of a number among equal rows, so
    reruns agree.  Columns that aren't read may have any name.  An empty table
    gives an empty table.

    A source is flown in buckets of about ``bucket_rows`` units, one in memory at a
    time, so neither a hot source nor a group of equal rows has to fit anywhere; the rows are shuffled without their texts.  The driver holds the
    totals of each source.
    """
    if bucket_rows <= LANDED:
        raise ValueError(f"bucket_rows must be above {LANDED}")
    spark = docs.sparkSession
    tag = work_dir(spark, "mix")
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORDS)), F.lit(0)).cast("bigint")
    more = [f"__keep{i}" for i in range(len(keep))]
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), *(F.col(c).alias(m) for c, m in zip(keep, more, strict=True)))
    units = written(numbered_repeats(plain), f"{tag}/units")
    totals = {r["source"]: (r["s"], r["n"]) for r in units.groupBy("source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    given = weights if isinstance(weights, dict) else {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = target_sizes({s: totals[s][0] for s in names}, given, share, most)
    facts = spark.createDataFrame(
        [(s, i, totals[s][0], float(target[s]), max(1, -(-totals[s][1] // bucket_rows))) for i, s in enumerate(names)],
        T.StructType([T.StructField("__source", units.schema["source"].dataType), T.StructField("__sid", T.IntegerType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("__buckets", T.LongType())]),
    )
    facts = F.broadcast(facts) if len(names) <= BROADCAST_SOURCES else facts
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = units.join(facts, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    known = known.withColumn("__copies", copies).withColumn("__base", F.floor(F.col("__copies") + _EPS).cast("int"))
    fraction = F.col("__copies") - F.col("__base")
    known = known.withColumn("__p", F.when((fraction < _EPS) | (F.col("size") == 0), 0.0).otherwise(fraction)).withColumn("__h", F.xxhash64(F.lit(seed), "doc_id", "size", "__nth", *more))
    flown = known.select("doc_id", "source", "size", *more, "source_size", "target", "__sid", "__base", "__h", "__p", F.pmod("__h", "__buckets").alias("__bucket"))

    decided, level, open_rows = [], 0, flown
    most_buckets = max([-(-totals[s][1] // bucket_rows) for s in names], default=1)
    while True:
        last = most_buckets <= 1
        parts = shuffle_partitions(spark) if level == 0 else max(1, min(shuffle_partitions(spark), len(names)))
        dealt = open_rows.repartition(parts, "__sid", "__bucket").sortWithinPartitions("__sid", "__bucket", "__h", "doc_id", "size")
        done = written(dealt.mapInPandas(_flight(dealt.columns, seed + level, last), dealt.schema), f"{tag}/level-{level}")
        is_open = (F.col("__p") > 0) & (F.col("__p") < 1)
        decided.append(done.where(~is_open))
        if last:
            break
        # At most LANDED units of each bucket are left.
        most_buckets = -(-LANDED * most_buckets // bucket_rows)
        open_rows = done.where(is_open).withColumn("__bucket", F.pmod("__h", F.lit(most_buckets)))
        level += 1
    rows = decided[0]
    for some in decided[1:]:
        rows = rows.unionByName(some)
    taken = (F.col("size") * (F.col("__base") + F.col("__p").cast("int"))).cast("bigint").alias("taken")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken, *(F.col(m).alias(c) for c, m in zip(keep, more, strict=True)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, [3, 1, 2]).select("doc_id", "size", "source_size", "target", "taken")
