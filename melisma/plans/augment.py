"""New tiers from signals: chunks, syllables, global segments and accents.

Candidates are all recordings' in one table; ``unit`` ``file`` classifies each
recording's channel by itself, ``batch`` the whole corpus together, with the same plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import augment, detect, interval
from ..storage import saved
from . import prosody

KEY = ["fi", "ci"]


def _unit(conf: dict) -> list[str]:
    return KEY if conf["unit"] == "file" else []


def flat_weights(weights: dict, prefix: str = "") -> dict[str, float]:
    """Leaves of a tree of weights by their path, joined by ``_``; a list gives numbers."""
    out = {}
    for k, v in (enumerate(weights) if isinstance(weights, list) else weights.items()):
        name = f"{prefix}_{k}" if prefix else str(k)
        out |= flat_weights(v, name) if isinstance(v, (dict, list)) else {name: float(v)}
    return out


def file_parents(ends: DataFrame) -> DataFrame:
    """``fi, ci, si, on, off``: each recording as one segment."""
    return ends.select(*KEY, F.lit(0).alias("si"), F.lit(0.0).alias("on"), F.round("file_end", 2).alias("off"))


def boundary_candidates(contour: DataFrame, segments: DataFrame, chunks: DataFrame, conf: dict, line: dict, norm: float, phones: DataFrame | None = None, vowels: str = "") -> tuple[DataFrame, list[float]]:
    """The ends of segments (``fi, ci, si, on, off``) that another follows, with features,
    seeds and the weights in ``conf['wgt']`` (``std|win|trend``, then ``p`` or a register
    and a measure; ``pho``).  A reset counts by its magnitude."""
    tree = dict(conf["wgt"])
    pho = tree.pop("pho", 0.0)
    weights = {}
    for win, part in tree.items():
        for name, w in flat_weights(part).items():
            weights[f"{win}_bl_p" if name == "p" else f"{win}_{name}"] = w
    short = 0.1 if conf.get("heuristics") == "ORT" else None
    rows = augment.gap_seeds(segments, KEY, short)
    if not conf.get("use_gaps", True):
        rows = rows.withColumn("seed", F.when(F.col("seed") == 0, 0))
    feats = saved(prosody.boundaries(contour, segments, chunks, **line, norm=norm), "boundary-features")
    rows = rows.join(feats.select(*KEY, "si", *sorted(n for n, w in weights.items() if w > 0)), [*KEY, "si"], "left")
    if pho and phones is not None:
        rows = augment.vowel_scaled(augment.previous_vowel(rows, phones, KEY, vowels), _unit(conf))
        weights["vowel_dur"] = pho
    rows, used = augment.feature_vector(rows, weights, {n for n in weights if n.endswith("_r")})
    if conf["cntr_mtd"] == "seed_minmax":
        rows = augment.minmax_seeds(rows, _unit(conf), *conf.get("minmax_prct", (10, 90)))
    elif conf["cntr_mtd"].startswith("seed"):
        rows = augment.near_seeds(rows, KEY, conf["min_l"])
    return rows, used


def global_segments(contour: DataFrame, segments: DataFrame, parents: DataFrame, conf: dict, line: dict, norm: float = 1.0, phones: DataFrame | None = None, vowels: str = "") -> DataFrame:
    """``fi, ci, on, off``: segments joined between the boundaries that are found."""
    chunks = parents.select(*KEY, F.col("on").alias("c_on"), F.col("off").alias("c_off"))
    rows, weights = boundary_candidates(contour, segments, chunks, conf, line, norm, phones, vowels)
    rows = saved(rows.select(*KEY, "t", "v", "bad", "seed"), "boundary-candidates")
    marked = saved(augment.classified(rows, KEY, _unit(conf), weights, conf), "boundaries")
    return augment.cut_segments(segments, marked, parents, KEY, conf["min_l"])


def accent_candidates(contour: DataFrame, points: DataFrame, parents: DataFrame, conf: dict, line: dict, order: int = 3, register: str = "ml", width: float = 0.3, norm: float = 0.6, phones: DataFrame | None = None, vowels: str = "") -> tuple[DataFrame, list[float]]:
    """Points (``fi, ci, si, t``) inside a parent, with features and weights by the sets
    in ``conf['wgt']``: ``acc`` (coefficients ``c``), ``gst`` and ``decl`` (register, measure),
    ``gnl_f0`` and ``pho``.  Coefficients count by their magnitude unless ``c_no_abs``."""
    tree = conf["wgt"]
    c_on, c_off = F.col("on").alias("c_on"), F.col("off").alias("c_off")
    windows = prosody.point_segments(points, parents.select(*KEY, c_on, c_off), width, norm)
    inside = interval.range_join(windows, parents.select(*KEY, F.col("si").alias("gi"), F.col("on").alias("p_on"), F.col("off").alias("p_off")), KEY, "center", "p_on", "p_off", 60.0, "inner")
    by = [*KEY, "si"]
    inside = saved(inside.groupBy(*by, "on", "off", "center", "nrm_on", "nrm_off").agg(F.min("gi").alias("gi")), "accent-windows")
    rows = inside.select(*by).join(points.select(*by, "t"), by)
    weights: dict[str, float] = {}
    if "acc" in tree:
        shapes = saved(prosody.local_shapes(contour, inside, parents, order, register, **line), "accent-shapes")
        names = {f"c{k}": w for k, w in enumerate(tree["acc"].get("c", []))} | {k: w for k, w in tree["acc"].items() if k != "c"}
        weights |= {f"acc_{k}": w for k, w in names.items()}
        rows = rows.join(shapes.select(*by, *(F.col(k).alias(f"acc_{k}") for k in names)), by, "left")
    if "gst" in tree or "decl" in tree:
        more = prosody.local_extended(contour, inside, parents, order, **line)
        for part in ("gst", "decl"):
            names = flat_weights(tree.get(part, {}))
            weights |= {f"{part}_{k}": w for k, w in names.items()}
            rows = rows.join(more.select(*by, *(F.col(k).alias(f"{part}_{k}") for k in names)), by, "left")
    if "gnl_f0" in tree:
        names = flat_weights(tree["gnl_f0"])
        weights |= {f"gnl_{k}": w for k, w in names.items()}
        rows = rows.join(saved(prosody.general(contour, inside), "accent-general").select(*by, *(F.col(k).alias(f"gnl_{k}") for k in names)), by, "left")
    if tree.get("pho") and phones is not None:
        rows = augment.vowel_scaled(augment.previous_vowel(rows, phones, KEY, vowels), _unit(conf))
        weights["vowel_dur"] = float(tree["pho"])
    plain = set() if conf.get("c_no_abs") else {n for n in weights if n.startswith("acc_c") or n.rsplit("_", 1)[-1] in ("c0", "c1", "c2", "c3")}
    return augment.feature_vector(rows, weights, plain)


def accents(contour: DataFrame, points: DataFrame, groups: DataFrame | None, parents: DataFrame, conf: dict, line: dict, energy: DataFrame | None = None, **more) -> DataFrame:
    """``fi, ci, t``: the accented among syllables (``fi, ci, si, t``).

    With ``groups`` (``on, off``) of which one accent each is wanted: the leftmost or
    rightmost syllable beforehand, or the most prominent accent afterwards; all groups
    get theirs if ``ag_select`` is ``all`` and the choice is beforehand.  With ``force``
    a recording without accents gets one at its greatest energy.
    """
    before = groups is not None and conf["acc_select"] in ("left", "right")
    chosen = augment.preselect(points, groups, KEY, conf["acc_select"]) if before else points
    if before and conf["ag_select"] == "all":
        return chosen.select(*KEY, "t")
    rows, weights = accent_candidates(contour, chosen, parents, conf, line, **more)
    rows = saved(rows.select(*KEY, "t", "v", "bad").withColumn("seed", F.lit(None).cast("int")), "accent-candidates")
    if conf["cntr_mtd"] == "seed_minmax":
        rows = augment.minmax_seeds(rows, _unit(conf), *conf.get("minmax_prct", (10, 90)))
    elif conf["cntr_mtd"].startswith("seed") and groups is not None and conf.get("heuristics") == "ORT":
        rows = augment.word_seeds(rows, groups, KEY, weights, conf["max_l_na"], conf["min_l_a"])
    found = saved(augment.classified(rows, KEY, _unit(conf), weights, conf).where("class = 1"), "accents")
    if groups is not None and not before:
        found = augment.postselect(found, groups, KEY)
    return augment.forced(found, energy, KEY) if conf.get("force") and energy is not None else found.select(*KEY, "t")


def chunk_tier(blocks: DataFrame, conf: dict) -> DataFrame:
    """``path, ci, on, off``: chunks between the pauses of audio blocks."""
    found = detect.pauses(blocks, conf["e_rel"], conf["l"], conf["l_ref"], conf["n"], conf["min_pau_l"], conf["min_chunk_l"], conf["margin"], float(conf["flt"]["f"]), conf["flt"]["ord"])
    return detect.chunks(found, detect.loud_rms(blocks).select("path", "ci", "end"))


def syllable_tiers(blocks: DataFrame, parents: DataFrame, conf: dict) -> tuple[DataFrame, DataFrame]:
    """Nuclei (``path, ci, chunk, t, ratio``) and boundaries of syllables in parents
    (``path, ci, on, off``); with ``force`` a parent without a nucleus gets one in its
    middle."""
    low, high = map(float, conf["flt"]["f"])
    order = Window.partitionBy("path", "ci").orderBy("on")
    parents = parents.select("path", "ci", "on", "off").withColumn("chunk", F.row_number().over(order) - 1)
    nuclei, bounds = detect.nuclei(blocks, parents, conf["e_rel"], conf["e_val"], conf["e_min"], conf["l"], conf["l_ref"], conf["d_min"], low, high, conf["flt"]["ord"])
    if conf.get("force"):
        none = parents.join(nuclei.select("path", "ci", "chunk").distinct(), ["path", "ci", "chunk"], "left_anti")
        middle = none.select("path", "ci", "chunk", ((F.col("on") + F.col("off")) / 2).alias("t"), F.lit(None).cast("double").alias("ratio"))
        nuclei = nuclei.unionByName(middle)
    return nuclei, bounds


def missing_tiers(items: DataFrame, wanted: list[str]) -> list[str]:
    """Tiers that a step needs and no recording has."""
    have = {r["tier"] for r in items.select("tier").distinct().where(F.col("tier").isin(wanted)).collect()} if wanted else set()
    return [n for n in wanted if n not in have]

