"""Pauses, chunks and syllable nuclei from audio.

Audio comes as blocks of samples (``path, ci, rate, first, samples``; see
``sources.audio``).  A task filters and frames one block together with as much of
its neighbours as windows reach, so memory follows a block, not a recording, and
any block can be done again alone.  Frames, some tens a second, go on as rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.audio import BLOCK
from .interval import complement, islands, range_join

KEY = ["path", "ci"]
#: Seconds beyond the widest window over which the filter's transient dies down.
SETTLE = 0.1
#: Levels of a histogram of magnitudes: those of 16-bit audio.
LEVELS = 32768


def zero_phase_gain(freq: np.ndarray, rate: float, low: float | None, high: float | None, order: int) -> np.ndarray:
    """Gain of a digital Butterworth filter that is run forwards and backwards: its
    squared magnitude.  ``low`` alone is a high-pass, ``high`` alone a low-pass; an
    edge at or beyond half the rate does nothing."""
    half = rate / 2
    high = None if high is None or high >= half else high
    low = None if low is None or low <= 0 else low
    warp = lambda f: np.tan(np.pi * np.minimum(f, half * 0.999999) / rate)
    w = warp(np.asarray(freq, float))
    if low is None and high is None:
        return np.ones_like(w)
    with np.errstate(divide="ignore", over="ignore"):
        if low is None:
            x = w / warp(high)
        elif high is None:
            x = warp(low) / w
        else:
            a, b = warp(low), warp(high)
            x = (w * w - a * b) / (w * (b - a))
        return 1 / (1 + np.abs(x) ** (2 * order))


def zero_phase(x: np.ndarray, rate: float, low: float | None, high: float | None, order: int = 5) -> np.ndarray:
    """``x`` through the filter, extended at its ends by odd reflection."""
    if len(x) < 2:
        return x.astype(float)
    pad = min(len(x) - 1, int(SETTLE * rate))
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    size = 1 << (len(y) - 1).bit_length()
    gain = zero_phase_gain(np.fft.rfftfreq(size, 1 / rate), rate, low, high, order)
    return np.fft.irfft(np.fft.rfft(y, size) * gain, size)[pad : pad + len(x)]


def _reach(blocks: DataFrame, reach: Column) -> DataFrame:
    """Blocks, each also cut to what the block ``owner`` beside it sees within
    ``reach`` samples."""
    k = F.floor(F.col("first") / BLOCK)
    wide = F.ceil(reach / BLOCK)
    rows = blocks.withColumn("__k", k).withColumn("__n", F.size("samples")).withColumn("owner", F.explode(F.sequence(F.greatest(F.lit(0), k - wide), k + wide)))
    low = F.greatest(F.col("first"), F.col("owner") * BLOCK - reach)
    high = F.least(F.col("first") + F.col("__n"), (F.col("owner") + 1) * BLOCK + reach)
    cut = F.slice("samples", (low - F.col("first") + 1).cast("int"), (high - low).cast("int"))
    return rows.where(high > low).select(*KEY, "rate", "owner", low.alias("first"), cut.alias("samples"))


def _filtered(frame: pd.DataFrame, low: float | None, high: float | None, order: int) -> tuple[int, np.ndarray]:
    frame = frame.sort_values("first")
    x = np.concatenate([np.asarray(s, float) for s in frame["samples"]])
    return int(frame["first"].iloc[0]), zero_phase(x, float(frame["rate"].iloc[0]), low, high, order)


def _spans(at: np.ndarray, half: int, end: float) -> tuple[np.ndarray, np.ndarray]:
    """[on, off) around samples; one short at an edge grows to the other side."""
    on, off = np.maximum(0, at - half), np.minimum(at + half, end)
    short = np.maximum(0, 2 * half - 1 - (off - on))
    grown = np.where(on > 0, np.maximum(0, on - short), on), np.where(on > 0, off, np.minimum(end, off + short))
    return grown[0].astype(int), grown[1].astype(int)


def frames(blocks: DataFrame, step: float, width: float, ref: float, low: float | None = None, high: float | None = None, order: int = 5) -> DataFrame:
    """``path, ci, rate, n, t, e, e_ref, e_next``: every ``step`` seconds the RMS of the
    filtered signal in a window of ``width`` around ``t``, in one of ``ref``, and in
    the ``width`` that follows.  An empty recording has no rows."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rate, owner = int(frame["rate"].iloc[0]), int(frame["owner"].iloc[0])
        start, y = _filtered(frame, low, high, order)
        end = start + len(y)
        hop = max(1, int(step * rate))
        lo, hi = owner * BLOCK, min((owner + 1) * BLOCK, end)
        j = np.arange(-(-max(lo - 1, 0) // hop), -(-(hi - 1) // hop))
        at = 1 + j * hop
        total = np.concatenate([[0.0], np.cumsum(y * y)])

        def rms(on, off):
            n = np.maximum(off - on, 1)
            return np.sqrt(np.maximum(total[off - start] - total[on - start], 0) / n)

        halves = [max(1, int(round(w * rate)) // 2) for w in (width, ref)]
        after = at, np.minimum(at + max(1, int(round(width * rate))), end)
        e, e_ref = (rms(*_spans(at, h, end)) for h in halves)
        return pd.DataFrame({"path": key[0], "ci": key[1], "rate": rate, "n": j, "t": at / rate, "e": e, "e_ref": e_ref, "e_next": rms(*after)})

    reach = F.ceil((max(width, ref) + SETTLE) * F.col("rate")) + 2
    schema = "path string, ci int, rate int, n bigint, t double, e double, e_ref double, e_next double"
    return _reach(blocks, reach).groupBy(*KEY, "owner").applyInPandas(lambda k, f: run(k, f) if (f["first"] >= k[2] * BLOCK).any() else _none(schema), schema).where("t IS NOT NULL")


def _none(schema: str) -> pd.DataFrame:
    return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])


def loud_rms(blocks: DataFrame, low: float | None = None, high: float | None = None, order: int = 5) -> DataFrame:
    """``path, ci, loud, end``: RMS of the samples whose magnitude is above the
    recording's median magnitude, and its length in seconds.  Magnitudes are
    counted at the levels of 16-bit audio, so what a task sends has a bound."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        start, y = _filtered(frame, low, high, order)
        own = np.abs(y[max(0, key[2] * BLOCK - start) : max(0, (key[2] + 1) * BLOCK - start)])
        level = np.minimum((own * LEVELS).astype(int), 2 * LEVELS)
        n, sq = np.bincount(level), np.bincount(level, own * own)
        used = np.flatnonzero(n)
        return pd.DataFrame({"path": key[0], "ci": key[1], "rate": int(frame["rate"].iloc[0]), "level": used, "n": n[used], "sq": sq[used]})

    reach = F.ceil(SETTLE * F.col("rate"))
    levels = _reach(blocks, reach).groupBy(*KEY, "owner").applyInPandas(run, "path string, ci int, rate int, level bigint, n bigint, sq double")
    levels = levels.groupBy(*KEY, "rate", "level").agg(F.sum("n").alias("n"), F.sum("sq").alias("sq"))
    per = Window.partitionBy(*KEY)
    levels = levels.withColumn("__all", F.sum("n").over(per)).withColumn("__upto", F.sum("n").over(per.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)))
    above = F.col("__upto") * 2 > F.col("__all")
    found = levels.groupBy(*KEY, "rate").agg(F.sum(F.when(above, F.col("sq"))).alias("sq"), F.sum(F.when(above, F.col("n"))).alias("n"), F.sum("n").alias("all"))
    return found.select(*KEY, F.sqrt(F.col("sq") / F.col("n")).alias("loud"), (F.col("all") / F.col("rate")).alias("end"))


def pauses(
    blocks: DataFrame, e_rel: float = 0.1, width: float = 0.1524, ref: float = 5.0, least: int = -1, min_pause: float = 0.5, min_chunk: float = 0.2, margin: float = 0.0, high: float = 8000.0, order: int = 5
) -> DataFrame:
    """``path, ci, on, off, ratio, end``: where the energy is no more than ``e_rel`` of that
    around it (of the loud half of the recording, where all around is quiet).

    Windows that overlap make one pause; ``ratio`` is its mean energy ratio.  With
    ``least`` above 0 the threshold rises by 0.1 until a recording has that many
    pauses, or reaches 1.  Inner edges shrink by ``margin``; pauses shorter than
    ``min_pause`` go; pauses less than ``min_chunk`` apart are joined; a first
    onset below ``min_chunk`` becomes 0.  A recording without pauses has no row.
    """
    rel = [e_rel]
    while least > 0 and rel[-1] + 0.1 < 1.0:
        rel.append(rel[-1] + 0.1)
    loud = loud_rms(blocks, None, high, order)
    rows = frames(blocks, 0.05, width, ref, None, high, order).join(loud, KEY).withColumn("rel", F.explode(F.array(*map(F.lit, rel))))
    around = F.when(F.col("e_ref") <= F.col("loud") * F.col("rel"), F.col("loud")).otherwise(F.col("e_ref"))
    rows = rows.where(F.col("e") <= around * F.col("rel")).withColumn("ratio", F.when(around > 0, F.col("e") / around).otherwise(0.0))
    rows = rows.withColumn("on", F.greatest(F.lit(0.0), F.col("t") - width / 2)).withColumn("off", F.least(F.col("end"), F.col("t") + width / 2))
    by = [*KEY, "rel"]
    before = F.lag("off").over(Window.partitionBy(*by).orderBy("on"))
    runs = islands(rows, by, ["on"], F.col("on") >= before, "run").groupBy(*by, "run").agg(F.min("on").alias("on"), F.max("off").alias("off"), F.avg("ratio").alias("ratio"), F.max("end").alias("end"))
    if least > 0:
        runs = runs.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
        enough = F.min(F.when(F.col("__n") >= least, F.col("rel"))).over(Window.partitionBy(*KEY))
        runs = runs.withColumn("__rel", F.coalesce(enough, F.max("rel").over(Window.partitionBy(*KEY)))).where("rel = __rel").drop("__n", "__rel")
    inner = runs.withColumn("on", F.when(F.col("on") > 0, F.col("on") + margin).otherwise(F.col("on"))).withColumn("off", F.when(F.col("off") < F.col("end"), F.col("off") - margin).otherwise(F.col("off")))
    inner = inner.where(F.col("off") - F.col("on") >= min_pause)
    before = F.lag("off").over(Window.partitionBy(*KEY).orderBy("on"))
    joined = islands(inner, KEY, ["on"], F.col("on") - before >= min_chunk, "run").groupBy(*KEY, "run").agg(F.min("on").alias("on"), F.max("off").alias("off"), F.avg("ratio").alias("ratio"), F.max("end").alias("end"))
    return joined.select(*KEY, F.when(F.col("on") < min_chunk, 0.0).otherwise(F.col("on")).alias("on"), "off", "ratio", "end")


def strongest_pauses(found: DataFrame, n: int) -> DataFrame:
    """The ``n`` pauses of least energy ratio of each recording, the earlier of equal ones."""
    return found.withColumn("__r", F.row_number().over(Window.partitionBy(*KEY).orderBy("ratio", "on"))).where(F.col("__r") <= n).drop("__r")


def chunks(found: DataFrame, ends: DataFrame) -> DataFrame:
    """``path, ci, on, off``: what lies between pauses; ``ends`` holds ``path, ci, end`` of
    every recording, and one without pauses is one chunk."""
    between = complement(found, KEY, "on", "off", F.lit(0.0), F.col("end"))
    whole = ends.join(found.select(*KEY).distinct(), KEY, "left_anti").select(*KEY, F.lit(0.0).alias("on"), F.col("end").alias("off"))
    return between.unionByName(whole)


def nuclei(
    blocks: DataFrame, parents: DataFrame, e_rel: float = 1.07, e_val: float = 0.91, e_min: float = 0.16, width: float = 0.08, ref: float = 0.15, apart: float = 0.05, low: float = 200.0, high: float = 4000.0, order: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Syllable nuclei (``path, ci, chunk, t, ratio``) and boundaries (``path, ci,
    chunk, t``) within the parents (``path, ci, chunk, on, off``).

    A nucleus is a maximum of the energy that stands out from its surroundings and
    from the parent's loudest window, with a valley (below ``e_val`` of the weaker
    of the two) and three frames between it and the one before; failing that the
    stronger of the two stays.  Of nuclei nearer than ``apart`` the one of higher
    ratio stays.  Boundaries lie at the least energy between nuclei, and at the
    parent's end.  The choice is one ordered pass over a parent's frames.
    """
    rows = range_join(frames(blocks, 0.03, width, ref, low, high, order), parents, KEY, "t", "on", "off", 10.0, "inner")

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("t").drop_duplicates("t")
        e, t, off = f["e"].to_numpy(), f["t"].to_numpy(), float(f["off"].iloc[0])
        ratio = e / np.maximum(f["e_ref"].to_numpy(), 1e-300)
        peak = np.zeros(len(e), bool)
        peak[1:-1] = (e[1:-1] > e[:-2]) & (e[1:-1] > e[2:])
        peak &= (ratio >= e_rel) & (e > e_min * f["e_next"].max())
        kept: list[int] = []
        for k in np.flatnonzero(peak):
            if kept and (k - kept[-1] < 3 or e[kept[-1] : k + 1].min() >= e_val * min(e[kept[-1]], e[k])):
                if e[k] > e[kept[-1]]:
                    kept[-1] = k
                continue
            kept.append(k)
        spaced: list[int] = []
        for k in kept:
            if spaced and t[k] - t[spaced[-1]] < apart:
                if ratio[k] > ratio[spaced[-1]]:
                    spaced[-1] = k
            else:
                spaced.append(k)
        cuts = []
        for a, b in zip(spaced, spaced[1:]):
            cuts.append((t[a] + t[b]) / 2 if t[b] - t[a] < 0.1 else t[a + int(np.argmin(e[a : b + 1]))])
        out = [("nucleus", t[k], ratio[k]) for k in spaced] + [("boundary", c, None) for c in [*cuts, off]]
        return pd.DataFrame([(*key, *o) for o in out], columns=[*KEY, "chunk", "kind", "t", "ratio"])

    found = rows.groupBy(*KEY, "chunk").applyInPandas(run, "path string, ci int, chunk int, kind string, t double, ratio double")
    return found.where("kind = 'nucleus'").drop("kind"), found.where("kind = 'boundary'").drop("kind", "ratio")
