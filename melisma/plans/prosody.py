"""From contours, pulses and tiers to prosodic feature tables.

Times are read to two decimals and the contour lies on a grid of 100 samples a
second; a recording is ``fi, ci``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as fn
from ..operators import classify, fill, fit, interval, spectral, stats, windows
from ..storage import saved

RATE = 100.0
KEY = ["fi", "ci"]


def preprocess(f0: DataFrame, ends: DataFrame | None = None, factor: float = 3.0, percent: float = 5.0, groups: list[str] | None = None, method: str = "mean") -> DataFrame:
    """``fi, ci, i, t, y, base``: the contour without gaps, outliers and unvoiced
    parts, smoothed, in semitones over its base value.

    Padded with zeros from 0 to the file's end (``ends``: ``fi, end``), outliers set
    to 0, zeros filled by straight lines, smoothed, cut at 0.  With ``groups`` the
    base value is that of the group, over all its recordings.
    """
    groups = groups or KEY
    rows = f0.withColumn("i", F.bround(F.col("t") * RATE).cast("int"))
    rows = fill.dedup_times(rows.withColumnRenamed("t", "__sec"), KEY, F.col("i"), ["__sec"]).drop("t", "__sec")
    span = rows.groupBy(*KEY, *(g for g in groups if g not in KEY)).agg(F.max("i").alias("__last"))
    if ends is not None:
        span = span.join(ends, "fi", "left").withColumn("__last", F.greatest("__last", F.ceil(F.round(F.col("end") * RATE, 6)).cast("int")))
    grid = span.select(*KEY, *(g for g in groups if g not in KEY), F.explode(F.sequence(F.lit(0), "__last")).alias("i"))
    rows = grid.join(rows.select(*KEY, "i", "y"), [*KEY, "i"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
    rows = fill.mark_outliers(rows, KEY, "y", method, factor).withColumn("y", F.when(F.col("is_outlier"), 0.0).otherwise(F.col("y")))
    rows = fill.linear_fill(rows, KEY, "i", "y", F.col("y") == 0)
    rows = windows.savgol7(rows, KEY, "i", "filled").withColumn("y", F.greatest(F.coalesce("smooth", F.lit(0.0)), F.lit(0.0)))
    base = fill.base_value(rows, groups, "y", percent, least=1.0)
    rows = rows.join(base, groups)
    return rows.select(*KEY, *(g for g in groups if g not in KEY), "i", (F.col("i") / RATE).alias("t"), fn.semitone("y", "base").alias("y"), "base")


def slices(contour: DataFrame, segments: DataFrame, on: str = "on", off: str = "off") -> DataFrame:
    """Samples of each segment (``fi, ci, si, on, off``), by a range join in bins."""
    low, high = F.greatest(F.lit(0), fn.sec2idx(on, RATE)), fn.sec2idx(off, RATE)
    spans = segments.withColumn("__lo", low).withColumn("__hi", high)
    return interval.range_join(contour, spans, KEY, "i", "__lo", "__hi", RATE, "inner").drop("__lo", "__hi")


def with_norm(segments: DataFrame, contour: DataFrame, by: list[str]) -> DataFrame:
    """Standard features of segments (``on, off``) and over their normalization
    windows (``nrm_on, nrm_off``), and the quotients of the two."""
    feats = stats.std_feat("y", "i", RATE)
    own = slices(contour, segments).groupBy(*by).agg(*feats)
    wide = slices(contour, segments, "nrm_on", "nrm_off").groupBy(*by).agg(*feats)
    names = ["m", "sd", "med", "iqr", "max", "min", "maxpos", "dur"]
    # A window's duration is its length, not its number of samples.
    wide = wide.join(segments.select(*by, "nrm_on", "nrm_off"), by).withColumn("dur", F.col("nrm_off") - F.col("nrm_on"))
    return stats.normalized(own.join(wide.select(*by, *(F.col(c).alias(f"ref_{c}") for c in names)), by), names).drop(*(f"ref_{c}" for c in names))


def point_segments(points: DataFrame, chunks: DataFrame, width: float, norm: float) -> DataFrame:
    """Points (``fi, ci, si, t``) as segments with normalization windows inside the
    chunk (``fi, ci, c_on, c_off``) that holds them."""
    t = F.round("t", 2)
    rows = interval.range_join(points.withColumn("center", t), chunks, KEY, "center", "c_on", "c_off", 60.0)
    rows = rows.withColumn("on", F.greatest(F.round(t - width / 2, 2), F.lit(0.0))).withColumn("off", F.round(t + width / 2, 2))
    window = interval.norm_window(F.col("center"), F.col("on"), F.col("off"), F.coalesce("c_on", F.lit(0.0)), F.coalesce("c_off", F.lit(1e9)), norm)
    return rows.select(*KEY, "si", "on", "off", "center", *(F.round(c, 2).alias(n) for c, n in zip(window, ("nrm_on", "nrm_off"), strict=True)))


def whole_file(contour: DataFrame) -> DataFrame:
    """One row per recording: standard features, quotients and a parabola."""
    x = contour.withColumn("x", fit.unit_time(KEY, "i"))
    parts = [contour.groupBy(*KEY).agg(*stats.std_feat("y", "i", RATE), F.max("base").alias("bv")), stats.quotients(contour, KEY, "i", "y", int(RATE * 0.3)), fit.polynomial_fit(x, KEY, "x", "y", 2)]
    return parts[0].join(parts[1], KEY).join(parts[2], KEY)


def general(contour: DataFrame, segments: DataFrame) -> DataFrame:
    """Per segment: standard features with quotients, and the parabola."""
    by = [*KEY, "si"]
    rows = slices(contour, segments).withColumn("x", fit.unit_time(by, "i"))
    return with_norm(segments, contour, by).join(stats.quotients(rows, by, "i", "y", int(RATE * 0.3)), by).join(fit.polynomial_fit(rows, by, "x", "y", 2), by)


def registers(contour: DataFrame, segments: DataFrame, window: float = 0.1, p_low: float = 10.0, p_high: float = 90.0) -> DataFrame:
    """Base, mid and top line medians of each sample of each segment, with the time
    ``x`` in [0, 1]; medians of the wrong side of the fitted midline are filled in."""
    by = [*KEY, "si"]
    half = max(1, int(round(window * RATE)) // 2)
    # Windows reach over a segment's ends: the medians are the contour's.
    medians = windows.register_medians(contour, KEY, "i", "y", half, p_low, p_high)
    rows = slices(medians, segments).withColumn("x", fit.unit_time(by, "i"))
    return repair_lines(rows, by)


def repair_lines(rows: DataFrame, by: list[str], order: str = "i") -> DataFrame:
    """Medians of the wrong side of the midline over ``x`` filled in, and the range."""
    mid = rows.groupBy(*by).agg(*fit.line_fit("ml", "x"))
    rows = rows.join(mid, by).withColumn("__mid", F.col("slope") * F.col("x") + F.col("icpt")).drop("slope", "icpt")
    for c, wrong in (("bl", F.col("bl") > F.col("__mid")), ("tl", F.col("tl") < F.col("__mid"))):
        rows = fill.linear_fill(rows, by, order, c, wrong, f"__{c}").withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
    return rows.withColumn("rng", F.col("tl") - F.col("bl")).drop("__mid")


def global_lines(contour: DataFrame, segments: DataFrame, window: float = 0.1, p_low: float = 10.0, p_high: float = 90.0, raw: tuple[str, str] = ("on", "off")) -> DataFrame:
    """Per segment and register: intercept ``c0``, slope ``c1``, mean, rate, drop and
    reset against the segment before; and where lines cross.  Rates are over the
    time between the ``raw`` columns, which may be unrounded."""
    by = [*KEY, "si"]
    rows = registers(contour, segments, window, p_low, p_high)
    lines = []
    for r in fn.REGISTERS:
        slope, icpt = fit.line_fit(r, "x")
        lines += [slope.alias(f"{r}_c1"), icpt.alias(f"{r}_c0")]
    out = rows.groupBy(*by).agg(*lines, F.count(F.lit(1)).alias("n")).join(segments.select(*by, (F.col(raw[1]) - F.col(raw[0])).alias("__dur")), by)
    w = Window.partitionBy(*KEY).orderBy("si")
    for r in fn.REGISTERS:
        c0, c1 = F.col(f"{r}_c0"), F.col(f"{r}_c1")
        last = c0 + F.when(F.col("n") > 1, c1).otherwise(0.0)
        mean = (c0 + last) / 2
        out = out.withColumn(f"{r}_m", F.greatest(mean, F.lit(0.0)) if r == "rng" else mean)
        out = out.withColumn(f"{r}_rate", F.when((F.col("n") > 1) & (F.col("__dur") > 0), (last - c0) / F.col("__dur")).otherwise(0.0))
        out = out.withColumn(f"{r}_drop", F.col(f"{r}_rate") * F.col("n") / RATE).withColumn("__last", last)
        out = out.withColumn(f"{r}_r", c0 - F.coalesce(F.lag("__last").over(w), F.lit(0.0))).drop("__last")
    for a, b in (("tl", "ml"), ("tl", "bl"), ("ml", "bl")):
        t, y = fn.line_cross(F.col(f"{a}_c0"), F.col(f"{a}_c1"), F.col(f"{b}_c0"), F.col(f"{b}_c1"))
        out = out.withColumn(f"{a}_{b}_cross_t", t).withColumn(f"{a}_{b}_cross_f0", y)
    return out.drop("__dur")


def local_shapes(contour: DataFrame, segments: DataFrame, parents: DataFrame, order: int = 3, register: str = "ml", **line) -> DataFrame:
    """Coefficients of the residual contour of each local segment (``on, off, center,
    gi``) over time that is 0 at the centre, the RMS of the fit (``rmsd``) and the RMS error
    of each order (``rms_c0`` ...)."""
    by = [*KEY, "si"]
    lines = registers(contour, parents, **line)
    fitted = lines.groupBy(*by).agg(*fit.line_fit(register, "x"))
    rest = lines.join(fitted, by).withColumn("y", F.col("y") - (F.col("slope") * F.col("x") + F.col("icpt")))
    rest = rest.select(*KEY, F.col("si").alias("gi"), "i", "t", "y")
    spans = segments.withColumnRenamed("gi", "__gi")
    rows = slices(rest, spans).where("gi = __gi")
    w = Window.partitionBy(*by)
    x = fit.center_time(F.col("i"), fn.sec2idx("center", RATE), F.min("i").over(w), F.max("i").over(w))
    rows = rows.withColumn("x", x)
    out = fit.polynomial_fit(rows, by, "x", "y", order)
    for o in range(order, -1, -1):
        c = out if o == order else fit.polynomial_fit(rows, by, "x", "y", o)
        value = fn.polynomial([F.col(f"c{k}") for k in range(o + 1)], F.col("x"))
        errors = [fn.rmsd("y", value).alias(f"rms_c{o}")] + ([F.sqrt(F.avg(value * value)).alias("rmsd")] if o == order else [])
        out = out.join(rows.join(c.select(*by, *(f"c{k}" for k in range(o + 1))), by).groupBy(*by).agg(*errors), by)
    return out


def _aligned(segments: DataFrame, parents: DataFrame) -> DataFrame:
    """Segments cut to the samples that they share with their parent's time axis, and
    ``shift``, the samples by which the parent's run ahead.  That axis adds up hundredths
    of a second from its onset, so for some onsets a time falls short of a segment's
    that it should equal, and the samples from the next on stand for the segment's."""
    above = parents.select(*KEY, F.col("si").alias("gi"), F.col("on").alias("__p"), F.col("off").alias("__q"))
    rows = segments.join(above, [*KEY, "gi"])
    step = (F.col("__p") + 0.01) - F.col("__p")
    axis = lambda k: F.col("__p") + k * step
    low, high = (F.bround((F.col(c) - F.col("__p")) * RATE, 0).cast("int") for c in ("on", "off"))
    first = F.greatest(F.lit(0), low + F.when(axis(low) < F.col("on"), 1).otherwise(0))
    last = F.least(F.bround((F.col("__q") - F.col("__p")) * RATE, 0).cast("int"), high - F.when(axis(high) > F.col("off"), 1).otherwise(0))
    own = fn.sec2idx("off", RATE) - fn.sec2idx("on", RATE) + 1
    n = F.least(own, last - first + 1)
    shift = fn.sec2idx("__p", RATE) + first - fn.sec2idx("on", RATE)
    return rows.withColumn("shift", shift.cast("int")).withColumn("off", F.round(F.col("on") + (n - 1) / RATE, 2)).drop("__p", "__q")


def local_extended(contour: DataFrame, segments: DataFrame, parents: DataFrame, order: int = 3, raw: tuple[str, str] = ("on", "off"), **line) -> DataFrame:
    """Register lines of each local segment (``on, off, gi``), how they lie against its
    parent's lines on the same samples (``<register>_rms, _d, _sd, _d_init, _d_fin``), and
    ``res_<register>_c<k>``: coefficients of the contour less the parent's line, or for the
    range its place between the parent's base and top line."""
    by = [*KEY, "si"]
    times = segments.select(*by, F.col(raw[0]).alias("__a"), F.col(raw[1]).alias("__b"))
    segments = _aligned(segments.select(*by, "gi", "on", "off"), parents).join(times, by)
    own = global_lines(contour, segments, raw=("__a", "__b"), **line).select(*by, *(f"{r}_{k}" for r in fn.REGISTERS for k in ("c0", "c1", "m", "rate")))
    lines = lambda prefix: [c.alias(f"{prefix}{r}_{n}") for r in fn.REGISTERS for c, n in zip(fit.line_fit(r, "x"), ("slope", "icpt"), strict=True)]
    at = lambda prefix, r, x: F.col(f"{prefix}{r}_slope") * F.col(x) + F.col(f"{prefix}{r}_icpt")
    above = registers(contour, parents, **line)
    above = above.join(above.groupBy(*by).agg(*lines("p_")), by).select(*KEY, F.col("si").alias("__gi"), F.col("i").alias("__at"), *(at("p_", r, "x").alias(f"p_{r}") for r in fn.REGISTERS))
    rows = registers(contour, segments, **line)
    rows = rows.join(rows.groupBy(*by).agg(*lines("l_")), by)
    rows = rows.select(*by, "i", "y", F.col("gi").alias("__gi"), (F.col("i") + F.col("shift")).alias("__at"), *(at("l_", r, "x").alias(f"l_{r}") for r in fn.REGISTERS)).join(above, [*KEY, "__gi", "__at"])
    rows = saved(rows.withColumn("x", fit.unit_time(by, "i", -1.0, 1.0)), "gestalt")
    out = rows.groupBy(*by).agg(*(m for r in fn.REGISTERS for m in fit.gestalt_measures("i", f"l_{r}", f"p_{r}", f"{r}_")))
    rest = {r: F.col("y") - F.col(f"p_{r}") for r in fn.REGISTERS} | {"rng": fit.range_residual(F.col("y"), F.col("p_bl"), F.col("p_tl"))}
    long = rows.select(*by, "x", F.explode(F.array(*(F.struct(F.lit(r).alias("reg"), v.alias("rest")) for r, v in rest.items()))).alias("v")).select(*by, "x", "v.*")
    cells = fit.polynomial_fit(long, [*by, "reg"], "x", "rest", order)
    cells = cells.groupBy(*by).agg(*(F.max(F.when(F.col("reg") == r, F.col(f"c{k}"))).alias(f"res_{r}_c{k}") for r in fn.REGISTERS for k in range(order + 1)))
    return saved(own, "local-lines").join(out, by, "left").join(cells, by, "left")


#: Measures of a boundary, per window and register.
BOUNDARY = ["p", "r", "d_o", "d_m", "sd_prepost", "sd_pre", "sd_post", *(f"{m}{k}" for m in ("rms", "corrD", "rmsR", "aicI") for k in ("", "_pre", "_post"))]
WINDOWS = ["std", "win", "trend"]


def boundary_sides(segments: DataFrame, chunks: DataFrame, norm: float = 1.0) -> DataFrame:
    """``fi, ci, si, win, side, on, off, p``: what lies before (``side`` 0) and after
    the end of each segment (``fi, ci, si, on, off``) that another follows.

    ``std`` compares the two segments; ``win`` half of ``norm`` seconds on either side,
    inside the chunk; ``trend`` all of the chunk before and all after.  A segment
    outside every chunk (``fi, ci, c_on, c_off``) is a chunk to itself.
    """
    center = segments.withColumn("__c", (F.col("on") + F.col("off")) / 2)
    held = interval.range_join(center, chunks.select(*KEY, "c_on", "c_off"), KEY, "__c", "c_on", "c_off", 60.0)
    held = held.groupBy(*KEY, "si", "on", "off").agg(F.min("c_on").alias("c_on"), F.min("c_off").alias("c_off"))
    held = held.withColumn("c_on", F.coalesce("c_on", "on")).withColumn("c_off", F.coalesce("c_off", "off"))
    w = Window.partitionBy(*KEY).orderBy("on", "si")
    rows = held.withColumns({"__on": F.lead("on").over(w), "__off": F.lead("off").over(w), "__end": F.lead("c_off").over(w)}).where("__on IS NOT NULL")
    on, off, after = F.col("on"), F.col("off"), F.col("__on")
    spans = {
        "std": ((on, off), (after, F.col("__off"))),
        "win": ((F.greatest(off - norm / 2, F.col("c_on")), off), (after, F.least(after + norm / 2, F.col("__end")))),
        "trend": ((F.col("c_on"), off), (after, F.col("__end"))),
    }
    listed = [F.struct(F.lit(n).alias("win"), F.lit(k).alias("side"), a.alias("on"), b.alias("off")) for n, sides in spans.items() for k, (a, b) in enumerate(sides)]
    return rows.select(*KEY, "si", (after - off).alias("p"), F.explode(F.array(*listed)).alias("v")).select(*KEY, "si", "p", "v.*").where("off >= on")


def boundaries(contour: DataFrame, segments: DataFrame, chunks: DataFrame, window: float = 0.1, p_low: float = 10.0, p_high: float = 90.0, norm: float = 1.0) -> DataFrame:
    """One row per boundary with ``<window>_<register>_<measure>`` for the three windows
    of :func:`boundary_sides`, four register lines and the measures in ``BOUNDARY``.

    Lines are fitted to each side and to both together, time running from 0 to 1
    over the samples of each, pauses left out.  The last segment of a recording
    has no row; a side without samples makes its window's values null.
    """
    pair, own = [*KEY, "si", "win"], [*KEY, "si", "win", "side"]
    half = max(1, int(round(window * RATE)) // 2)
    medians = windows.register_medians(contour, KEY, "i", "y", half, p_low, p_high)
    rows = slices(medians, boundary_sides(segments, chunks, norm)).drop("y", "base")
    rows = rows.withColumn("__both", F.size(F.collect_set("side").over(Window.partitionBy(*pair)))).where("__both = 2").drop("__both")
    first_b = F.min(F.when(F.col("side") == 1, F.col("i"))).over(Window.partitionBy(*pair))
    rows = rows.withColumn("shared", (F.col("side") == 0) & (F.col("i") >= first_b))
    rank = F.row_number().over(Window.partitionBy(*pair, "shared").orderBy("i"))
    rows = rows.withColumn("__k", F.when(~F.col("shared"), rank))
    once = rows.where(~F.col("shared")).withColumn("x", fit.unit_time(pair, "__k"))
    lines = lambda side: [c.alias(f"{r}_{n}") for r in fn.REGISTERS for c, n in zip(fit.line_fit(r, "x"), (f"slope{side}", f"icpt{side}"), strict=True)]
    joint = repair_lines(once, pair, "__k").groupBy(*pair).agg(*lines("_ab"))
    rows = repair_lines(rows.withColumn("x", fit.unit_time(own, "i")), own)
    rows = rows.join(rows.groupBy(*own).agg(*lines("")), own).join(joint, pair)
    last = F.max("__k").over(Window.partitionBy(*pair))
    at = F.when(last > 1, (F.col("__k") - 1) / (last - 1)).otherwise(0.0)
    rows = rows.withColumn("__at", at).withColumn("i", F.col("i").cast("double"))
    reg = [F.struct(F.lit(r).alias("reg"), F.col(r).alias("y"), *(F.col(f"{r}_{c}").alias(c) for c in ("slope", "icpt", "slope_ab", "icpt_ab"))) for r in fn.REGISTERS]
    long = rows.select(*pair, "side", "p", "i", "x", "shared", "__at", F.explode(F.array(*reg)).alias("v")).select("*", "v.*")
    long = long.withColumn("__own", F.col("slope") * F.col("x") + F.col("icpt")).withColumn("__ab", F.col("slope_ab") * F.col("__at") + F.col("icpt_ab"))
    found = long.groupBy(*pair, "reg").agg(*fit.boundary_measures("i", "y", "side", F.col("shared")), F.max("p").alias("p"))
    pick = lambda n, r, m: F.max(F.when((F.col("win") == n) & (F.col("reg") == r), F.col(m))).alias(f"{n}_{r}_{m}")
    return found.groupBy(*KEY, "si").agg(*(pick(n, r, m) for n in WINDOWS for r in fn.REGISTERS for m in BOUNDARY))


def energy_contour(samples: DataFrame, rate: int, hop: float = 0.01, width: float = 0.05) -> DataFrame:
    """``fi, ci, i, t, y, base``: energy under a Hamming window, from samples ``fi, ci, i, x``,
    on the contour's grid.  Only whole windows count."""
    step, size = round(hop * rate), round(width * rate)
    ends = samples.groupBy(*KEY).agg((F.max("i") + 1).alias("__n"))
    frames = windows.frame_energy(samples, KEY, "i", "x", step, size).join(ends, KEY).where(F.col("frame") * step < F.col("__n") - size)
    return frames.select(*KEY, F.col("frame").cast("int").alias("i"), ((F.col("frame") + 1) * hop).alias("t"), F.col("energy").alias("y"), F.lit(1.0).alias("base"))


def spectral_balance(samples: DataFrame, by: list[str], alpha: float = 0.95) -> DataFrame:
    """``by, sb, rms``: level in dB that pre-emphasis adds to the samples (``i, x``) of
    each group, and their RMS.  Silence has no balance."""
    rows = samples.withColumn("__p", windows.pre_emphasis("x", by, "i", alpha))
    rms = lambda c: F.sqrt(F.avg(F.pow(F.col(c), 2)))
    ratio = fn.safe_div(rms("__p"), rms("x"))
    return rows.groupBy(*by).agg(F.when(ratio > 0, 20 * F.log10(ratio)).alias("sb"), rms("x").alias("rms"))


def energy_features(samples: DataFrame, rate: int, contour: DataFrame, segments: DataFrame, hop: float = 0.01, width: float = 0.05) -> DataFrame:
    """Per segment (``on, off, nrm_on, nrm_off``): the general features of the energy,
    RMS of the signal and against that of the normalization window, spectral
    balance, and the correlation of energy with f0."""
    by = [*KEY, "si"]
    frames = energy_contour(samples, rate, hop, width)
    timed = samples.withColumn("__t", F.col("i") / rate)
    held = lambda on, off: interval.range_join(timed, segments.select(*KEY, "si", on, off), KEY, "__t", on, off, 1.0, "inner")
    balance = spectral_balance(held("on", "off"), by)
    around = held("nrm_on", "nrm_off").groupBy(*by).agg(F.sqrt(F.avg(F.pow("x", F.lit(2)))).alias("__around"))
    both = slices(frames, segments).join(contour.select(*KEY, "i", F.col("y").alias("__f0")), [*KEY, "i"])
    corr = both.groupBy(*by).agg(fn.guarded_corr("y", "__f0").alias("r_en_f0"))
    out = general(frames, segments).join(balance, by, "left").join(around, by, "left").join(corr, by, "left")
    return out.withColumn("rms_nrm", F.col("rms") / F.when(F.col("__around") > 0, F.col("__around")).otherwise(1.0)).drop("__around")


def summary(tables: dict[str, DataFrame], tiers: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per recording: ``<set>_<feature>_<stat>`` with mean, median, deviation and
    interquartile range of each number in each segment table, ``<set>_file_<feature>``
    with the value itself for tables of whole files (names ending in ``_file``), and
    the entropy in bits of a table's ``class``.  For a table with ``tiers`` (values of
    its column ``tier``) there are such columns per tier, named ``<set>_<tier>_...``.  A
    recording that some table doesn't have keeps its row, with nulls."""
    out = None
    for name, df in sorted(tables.items()):
        numbers = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "integer", "long") and f.name not in (*KEY, "si", "gi", "n", "class")]
        count = F.count(F.lit(1)).alias(f"{name}_n")
        if name.endswith("_file"):
            part = df.groupBy(*KEY).agg(count, *(F.first(c).alias(f"{name}_{c}") for c in numbers))
        else:
            # Long form first: a wide table would make as many percentile buffers as cells.
            names = (tiers or {}).get(name)
            by = F.concat(F.lit(f"{name}_"), F.col("tier"), F.lit("_")) if names else F.lit(f"{name}_")
            long = stats.summary_long(df.select(*KEY, by.alias("__by"), *(F.col(c).cast("double") for c in numbers)), [*KEY, "__by"], numbers)
            kinds = ["m", "med", "sd", "iqr"]
            cells = F.explode(F.array(*(F.struct(F.concat("__by", "feat", F.lit(f"_{k}")).alias("key"), F.col(k).alias("value")) for k in kinds)))
            rows = long.select(*KEY, cells.alias("__c")).groupBy(*KEY).agg(F.map_from_entries(F.collect_list("__c")).alias("__m"))
            keys = [f"{name}_{t}{c}_{k}" for t in ([f"{t}_" for t in names] if names else [""]) for c in numbers for k in kinds]
            rows = rows.select(*KEY, *(F.col("__m")[k].alias(k) for k in keys))
            part = df.groupBy(*KEY).agg(count).join(rows, KEY, "left")
        if "class" in df.columns:
            part = part.join(stats.entropy(df, KEY, "class").withColumnRenamed("entropy", f"{name}_class_h"), KEY, "left")
        out = part if out is None else out.join(part, KEY, "full")
    if out is None:
        raise ValueError("no tables to sum up")
    return out


def rhythm(contour: DataFrame, segments: DataFrame, upper: float = 10.0, drop_mean: bool = True, beta: float | None = 1.0) -> DataFrame:
    """Spectral moments and the strongest frequency of each segment's contour."""
    by = [*KEY, "si"]
    return spectral.spectral_moments(spectral.band_dct(slices(contour, segments), by, "i", "y", RATE, upper, drop_mean=drop_mean, beta=beta), by)


def _voice(pulses: DataFrame, by: list[str], amplitudes: bool, t_min: float, t_max: float, fac_max: float) -> DataFrame:
    def shape(rows: DataFrame, t: str, change: str, name: str) -> DataFrame:
        rows = rows.withColumn("__x", fit.unit_time(by, t, -1.0, 1.0))
        return fit.polynomial_fit(rows, by, "__x", change, 3).select(*by, *(F.col(f"c{k}").alias(f"{name}_c{k}") for k in range(4)))

    mean = F.avg("__d").over(Window.partitionBy(*by))
    used = stats.periods(pulses, by, "t", t_min, t_max, fac_max).withColumn("__rel", F.abs(F.col("__d") - F.col("__e")) / mean)
    out = stats.jitter(pulses, by, "t", t_min, t_max, fac_max).join(shape(used, "__t1", "__rel", "jit"), by, "left")
    if amplitudes:
        w = Window.partitionBy(*by)
        heard = pulses.where("a IS NOT NULL")
        steps = heard.withColumn("__rel", F.abs(F.abs("a") - F.abs(F.lag("a").over(w.orderBy("t")))) / F.avg(F.abs("a")).over(w)).where("__rel IS NOT NULL")
        out = out.join(stats.shimmer(heard, by, "t", "a"), by, "full").join(shape(steps, "t", "__rel", "shim"), by, "left")
    return out


def voice(pulses: DataFrame, segments: DataFrame | None = None, t_min: float = 0.0001, t_max: float = 0.02, fac_max: float = 1.3) -> DataFrame:
    """Jitter per segment, or per recording without segments, with the cubic of its
    course; shimmer too where the pulses have amplitudes ``a`` (see :func:`pulse_levels`).
    In segments ``_nrm`` is a value over the recording's."""
    levels = "a" in pulses.columns
    whole = _voice(pulses, KEY, levels, t_min, t_max, fac_max)
    if segments is None:
        return whole
    by = [*KEY, "si"]
    held = interval.range_join(pulses, segments, KEY, "t", "on", "off", 1.0, "inner")
    out = _voice(held, by, levels, t_min, t_max, fac_max)
    names = [c for c in ("jit", "jit_m", "jit_sd", "shim", "shim_m", "shim_sd") if c in out.columns]
    out = out.join(whole.select(*KEY, *(F.col(c).alias(f"__{c}") for c in names)), KEY, "left")
    for c in names:
        out = out.withColumn(f"{c}_nrm", fn.safe_div(F.col(c), F.col(f"__{c}"))).drop(f"__{c}")
    return out


def pulse_levels(pulses: DataFrame, samples: DataFrame, rate: int) -> DataFrame:
    """Adds ``a``, the sample (``fi, ci, i, x``) at each pulse; null beyond the last."""
    rows = pulses.withColumn("i", fn.sec2idx("t", float(rate)))
    return rows.join(samples.select(*KEY, "i", F.col("x").alias("a")), [*KEY, "i"], "left").drop("i")


def resynthesize(contour: DataFrame, local: DataFrame, level: Column, base: Column) -> DataFrame:
    """``y_hz``: fitted local contour (``fit``) plus register level in Hz, 0 outside."""
    rows = contour.join(local, [*KEY, "i"], "left")
    return rows.withColumn("y_hz", F.coalesce(fn.hertz(F.col("fit") + level, base), F.lit(0.0)))


def contour_classes(shapes: DataFrame, key: str, coefficients: list[str], bandwidth: float | None = None, clusters: int | None = None) -> DataFrame:
    """Classes of contour shapes over robust-scaled coefficients by mean shift, or by
    k-means into so many ``clusters``, from the shapes of least key hashes."""
    vectors = shapes.select(key, F.array(*coefficients).alias("v"))
    scaled = classify.as_vectors(classify.robust_scale(classify.long_vectors(vectors, key, "v")), key, "z", "v")
    if clusters is None:
        return classify.mean_shift(scaled, key, "v", bandwidth)
    start = [r["v"] for r in scaled.groupBy("v").agg(F.min(F.xxhash64(key)).alias("h")).orderBy("h", "v").limit(clusters).collect()]
    return classify.kmeans(scaled, key, "v", start) if start else scaled.select(key, F.lit(0).alias("class"), F.lit(0.0).alias("dist"))
