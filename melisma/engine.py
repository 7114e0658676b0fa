"""From settings to feature tables: read, preprocess, run the stages, export.

The contour and the table of each stage are written as Parquet in the shared
folder, so stages share the work before them and a lost executor costs one stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import config, sources
from .functions import scalar as fn
from .operators import augment, detect, interval, spectral
from .plans import augment as augmentation
from .plans import prosody
from .sources import audio, sinks
from .storage import saved

KEY = ["fi", "ci"]
READERS = {"TextGrid": sources.read_textgrid, "par": sources.read_partitur, "xml": sources.read_tier_xml}


class Corpus:
    """The files of a corpus as tables; recordings are matched by the stem of their name."""

    def __init__(self, spark: SparkSession, conf: dict):
        self.spark, self.conf, fs = spark, conf, conf["fsys"]
        f0 = sources.read_contour(spark, *self._where("f0"))
        # A corpus to be augmented may have no tiers yet.
        annot = READERS[fs["annot"]["typ"]](spark, *self._where("annot")) if fs["annot"]["dir"] else None
        self.recordings = sources.recordings(f0, fs["grp"]["lab"], fs["grp"]["sep"]).drop("path")
        self.recordings = saved(self.recordings, "recordings")
        self.f0 = saved(self._numbered(f0), "f0")
        if annot is not None:
            self.items = saved(self._numbered(annot), "items")
        else:
            self.items = spark.createDataFrame([], "fi int, tier string, class string, item_idx int, xmin double, xmax double, label string, file_end double")
        ends = self.items.groupBy("fi").agg(F.max("file_end").alias("end"))
        part = conf["preproc"]
        f0, groups = self.f0, None
        if part["base_prct_grp"]:
            # One base value for the recordings of a group, by the channel's grouping.
            own = F.col("fi").cast("string")
            for channel, lab in part["base_prct_grp"].items():
                own = F.when(F.col("ci") == int(channel) - 1, F.concat(F.lit(f"{channel}:"), F.col(f"grp_{lab}"))).otherwise(own)
            f0 = f0.join(self.recordings.select("fi", *sorted({f"grp_{x}" for x in part["base_prct_grp"].values()})), "fi").withColumn("base_group", own).select(*f0.columns, "base_group")
            groups = ["base_group"]
        contour = prosody.preprocess(f0, ends, part["out"]["f"], part["base_prct"], groups, part["out"]["m"])
        self.contour = saved(contour.select(*KEY, "i", "t", "y", "base"), "contour")

    def _where(self, kind: str) -> tuple[str, str]:
        part = self.conf["fsys"][kind]
        return part["dir"], f"*.{part['ext']}"

    def _numbered(self, df: DataFrame) -> DataFrame:
        return df.withColumn("stem", fn.stem("path")).drop("path").join(self.recordings.select("stem", "fi"), "stem").drop("stem")

    def tier(self, name: str) -> DataFrame:
        """``fi, ci, si, on, off, xmin, xmax, label``: a tier's items that are no pauses, numbered in order of time."""
        ci = int(self.conf["fsys"]["channel"].get(name, 1)) - 1
        rows = self.items.where((F.col("tier") == name) & ((F.col("class") == "TextTier") | ~fn.is_pause("label", self.conf["fsys"]["label"]["pau"])))
        si = F.row_number().over(Window.partitionBy("fi").orderBy("xmin", "item_idx")) - 1
        return rows.select("fi", F.lit(ci).alias("ci"), si.alias("si"), F.round("xmin", 2).alias("on"), F.round("xmax", 2).alias("off"), "xmin", "xmax", "label", "class")

    def chunks(self) -> DataFrame:
        """``fi, ci, c_on, c_off``: the chunk tiers, or from first to last contour time."""
        names = self.conf["fsys"]["chunk"]["tier"]
        if names:
            return _union(self.tier(n).select(*KEY, F.col("on").alias("c_on"), F.col("off").alias("c_off")) for n in names)
        return self.f0.groupBy(*KEY).agg(F.min("t").alias("c_on"), F.max("t").alias("c_off"))

    def windows(self, name: str) -> DataFrame:
        """Segments of a tier (points as windows around them) with normalization windows."""
        conf, rows = self.conf["preproc"], self.tier(name)
        points = prosody.point_segments(rows.where("xmin = xmax").select(*KEY, "si", F.col("xmin").alias("t")), self.chunks(), conf["point_win"], conf["nrm_win"])
        center = F.round((F.col("on") + F.col("off")) / 2, 2)
        spans = interval.range_join(rows.where("xmin < xmax").select(*KEY, "si", "on", "off", center.alias("center")), self.chunks(), KEY, "center", "c_on", "c_off", 60.0)
        norm = interval.norm_window(F.col("center"), F.col("on"), F.col("off"), F.coalesce("c_on", F.lit(0.0)), F.coalesce("c_off", F.lit(1e9)), conf["nrm_win"])
        spans = spans.select(*KEY, "si", "on", "off", "center", *(F.round(c, 2).alias(n) for c, n in zip(norm, ("nrm_on", "nrm_off"), strict=True)))
        return points.unionByName(spans)

    def pulses(self) -> DataFrame:
        return self._numbered(sources.read_pulses(self.spark, *self._where("pulse")))

    def blocks(self) -> DataFrame:
        return audio.read_wav(self.spark, *self._where("aud"))

    def samples(self) -> list[tuple[DataFrame, int]]:
        """``fi, ci, i, x`` of the recordings of each sample rate, and the rate."""
        blocks = self.blocks()
        rates = sorted(r["rate"] for r in blocks.select("rate").distinct().collect())
        if not rates:
            raise ValueError("energy needs audio, found none")
        return [(self._numbered(audio.samples(blocks.where(F.col("rate") == r), center=True)).select(*KEY, "i", "x"), r) for r in rates]

    def ends(self) -> DataFrame:
        """``fi, ci, file_end`` of each channel: its tiers' end, or the contour's last time."""
        last = self.f0.groupBy(*KEY).agg(F.max("t").alias("__t"))
        return last.join(self.items.groupBy("fi").agg(F.max("file_end").alias("__e")), "fi", "left").select(*KEY, F.coalesce("__e", "__t").alias("file_end"))

    def segments(self, names: list[str]) -> DataFrame:
        """Segments of tiers, numbered; the recording itself without a tier."""
        if not names:
            return augmentation.file_parents(self.ends())
        return _renumbered(_union(self.tier(n) for n in names), "on").select(*KEY, "si", "on", "off")

    def add(self, tier: DataFrame) -> None:
        self.items = saved(augment.add_tiers(self.items, tier, ["fi"]), "items")


def _union(tables) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def _renumbered(rows: DataFrame, t: str) -> DataFrame:
    """Segments of all tiers of a recording's channel, numbered in order of time."""
    return rows.withColumn("si", F.row_number().over(Window.partitionBy(*KEY).orderBy(t, "si")) - 1)


def _per_tier(conf: dict, kind: str, build) -> DataFrame:
    """What ``build`` makes of each tier of a kind of features, with the tier's name."""
    names = conf["fsys"][kind]["tier"]
    if not names:
        raise ValueError(f"fsys.{kind}.tier names no tier")
    return _union(build(n).withColumn("tier", F.lit(n)) for n in names)


def _lines(part: dict) -> dict:
    return {"window": part["decl_win"], "p_low": float(part["prct"]["bl"]), "p_high": float(part["prct"]["tl"])}


def local_groups(corpus: Corpus, parents: DataFrame) -> DataFrame:
    """``fi, ci, si, on, off, center, raw_on, raw_off, gi``: accents with the accent group that holds them
    and the global segment that holds their centre; an accent without either goes."""
    fs = corpus.conf["fsys"]["loc"]
    points = _renumbered(_union(corpus.tier(n).select(*KEY, "si", F.round("xmin", 2).alias("center")) for n in fs["tier_acc"]), "center")
    if fs["tier_ag"]:
        groups = _union(corpus.tier(n).select(*KEY, "on", "off", F.col("xmin").alias("raw_on"), F.col("xmax").alias("raw_off")) for n in fs["tier_ag"])
        found = interval.range_join(points, groups, KEY, "center", "on", "off", 5.0, "inner").groupBy(*KEY, "si", "center").agg(F.min(F.struct("on", "off", "raw_on", "raw_off")).alias("g")).select(*KEY, "si", "center", "g.*")
    else:
        half = corpus.conf["preproc"]["point_win"] / 2
        found = points.withColumn("on", F.greatest(F.lit(0.0), F.col("center") - half)).withColumn("off", F.col("center") + half)
        found = found.withColumn("raw_on", F.col("on")).withColumn("raw_off", F.col("off"))
    above = parents.select(*KEY, F.col("si").alias("gi"), F.col("on").alias("p_on"), F.col("off").alias("p_off"))
    rows = interval.range_join(found, above, KEY, "center", "p_on", "p_off", 60.0, "inner")
    return rows.groupBy(*KEY, "si", "on", "off", "center", "raw_on", "raw_off").agg(F.min("gi").alias("gi"))


def _rhythm(contour: DataFrame, segments: DataFrame, part: dict, rates: list[tuple[str, DataFrame]]) -> DataFrame:
    """Moments, peaks and strongest frequency, and per rate tier its events a second, their
    share of the spectrum, their distance from peaks and the error without the others."""
    by, rhy = [*KEY, "si"], part["rhy"]
    spec = saved(spectral.band_dct(prosody.slices(contour, segments), by, "i", "y", prosody.RATE, float(rhy["ub"]), float(rhy["lb"]), rhy["rmo"], rhy["winparam"]), "spectrum")
    out = spectral.spectral_moments(spec, by)
    peaks = spectral.spectral_peaks(spec.join(out.select(*by, "sm1"), by), by, "sm1", 1.0, float(rhy["peak_prct"]))
    out = out.join(peaks, by, "left")
    lowest = spec.groupBy(*by).agg(F.min("k").alias("__k0"))
    for name, points in rates:
        held = interval.range_join(points.select(*KEY, F.col("on").alias("t")), segments.select(*KEY, "si", "on", "off"), KEY, "t", "on", "off", 60.0, "inner")
        counts = held.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
        rate = segments.join(counts, by, "left").select(*by, fn.safe_div(F.coalesce("__n", F.lit(0)).cast("double"), F.col("off") - F.col("on")).alias(f"{name}_rate"))
        rated = spec.join(rate, by).join(lowest, by)
        share = spectral.rate_share(rated, by, F.col(f"{name}_rate"), float(rhy["wgt"]["rb"]))
        error = spectral.rate_error(rated, by, F.col(f"{name}_rate"), "n", 1 if rhy["rmo"] else 0, float(rhy["wgt"]["rb"]))
        out = out.join(rate, by, "left").join(share.withColumnsRenamed({"prop": f"{name}_prop", "dgm": f"{name}_dgm"}), by, "left").join(error.withColumnRenamed("mae", f"{name}_mae"), by, "left")
        out = out.withColumn(f"{name}_dlm", F.when(F.size("peaks") > 0, spectral.nearest_peak(F.col(f"{name}_rate"), F.col("peaks"))))
    return out.drop("peaks")


def _augmented(corpus: Corpus, on: dict) -> None:
    """Adds the tiers that are asked for, each before the next detector reads them."""
    conf, fs = corpus.conf["augment"], corpus.conf["fsys"]
    out, labels = fs["augment"], fs["label"]
    line = _lines(corpus.conf["styl"]["glob"])

    def keep(rows: DataFrame, name: str, label: str) -> None:
        rows = saved(rows, name)
        for ci in sorted(r["ci"] for r in rows.select("ci").distinct().collect()):
            tier = f"{name}_{ci + 1}"
            own = rows.where(F.col("ci") == ci)
            corpus.add(augment.as_tier(own, KEY, tier, label, corpus.ends()).drop("ci"))
            fs["channel"][tier] = ci + 1

    def tiers(name: str) -> list[str]:
        """Tiers that augmentation has made under a name, one a channel."""
        return sorted(t for t in fs["channel"] if t.startswith(f"{name}_"))

    def parents(part: dict) -> list[str]:
        names = part["tier_parent"] or tiers(out["chunk"]["tier_out_stm"])
        if missing := augmentation.missing_tiers(corpus.items, names):
            raise ValueError(f"no recording has {', '.join(missing)}")
        return names

    if on["do_augment_chunk"]:
        keep(corpus._numbered(augmentation.chunk_tier(corpus.blocks(), conf["chunk"])), out["chunk"]["tier_out_stm"], labels["chunk"])
    if on["do_augment_syl"]:
        names, blocks = parents(out["syl"]), corpus.blocks()
        if names:
            # Audio goes by its own paths.
            paths = blocks.select("path").distinct().withColumn("stem", fn.stem("path")).join(corpus.recordings.select("stem", "fi"), "stem").select("fi", "path")
            above = saved(corpus.segments(names).join(paths, "fi").select("path", "ci", "on", "off"), "syllable-parents")
        else:
            above = saved(detect.loud_rms(blocks).select("path", "ci", F.lit(0.0).alias("on"), F.col("end").alias("off")), "syllable-parents")
        nuclei, bounds = augmentation.syllable_tiers(blocks, above, conf["syl"])
        keep(corpus._numbered(nuclei.select("path", "ci", "t")), out["syl"]["tier_out_stm"], labels["syl"])
        keep(corpus._numbered(bounds.select("path", "ci", "t")), f"{out['syl']['tier_out_stm']}_bnd", labels["syl"])
    phones = _union(corpus.tier(n).select(*KEY, "on", "off", "label") for n in fs["pho"]["tier"]) if fs["pho"]["tier"] else None
    if on["do_augment_glob"]:
        part = out["glob"]
        segments, above = saved(corpus.segments(part["tier"]), "segments"), saved(corpus.segments(parents(part)), "parents")
        found = augmentation.global_segments(corpus.contour, segments, above, conf["glob"], line, corpus.conf["styl"]["bnd"]["win"], phones, fs["pho"]["vow"])
        keep(found, part["tier_out_stm"], "x")
    if on["do_augment_loc"]:
        part, pre = out["loc"], corpus.conf["preproc"]
        names = part["tier_acc"] or tiers(out["syl"]["tier_out_stm"])
        points = _renumbered(_union(corpus.tier(n).select(*KEY, "si", F.round((F.col("xmin") + F.col("xmax")) / 2, 2).alias("t")) for n in names), "t")
        points = saved(points, "points")
        groups = saved(corpus.segments(part["tier_ag"]), "accent-groups") if part["tier_ag"] else None
        above = saved(corpus.segments(part["tier_parent"] or tiers(out["glob"]["tier_out_stm"])), "phrases")
        loud = _union(prosody.energy_contour(x, r) for x, r in corpus.samples()) if conf["loc"]["force"] else None
        found = augmentation.accents(corpus.contour, points, groups, above, conf["loc"], line, loud, order=corpus.conf["styl"]["loc"]["ord"], register=corpus.conf["styl"]["register"], width=pre["point_win"], norm=pre["nrm_win"], phones=phones, vowels=fs["pho"]["vow"])
        keep(found, part["tier_out_stm"], "x")


def diagnosis(corpus: Corpus, kinds: tuple[str, ...] = ("glob", "bnd", "gnl_f0", "gnl_en", "rhy_f0", "rhy_en", "voice")) -> DataFrame:
    """``fi, ci, kind, tier, n, n_short, shortest``: segments of each tier that a kind of
    features reads, and how many end before they begin or hold under three samples; a
    tier that no recording has gives a row without a recording."""
    fs, parts = corpus.conf["fsys"], []
    for kind in kinds:
        for name in fs[kind]["tier"]:
            rows = corpus.tier(name)
            length = F.col("off") - F.col("on")
            short = (F.col("class") != "TextTier") & (length < 3 / prosody.RATE - 1e-9)
            stats = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum(short.cast("int")).alias("n_short"), F.min(length).alias("shortest"))
            if augmentation.missing_tiers(corpus.items, [name]):
                stats = corpus.spark.createDataFrame([(None, None, 0, 0, None)], "fi int, ci int, n bigint, n_short bigint, shortest double")
            parts.append(stats.withColumn("kind", F.lit(kind)).withColumn("tier", F.lit(name)))
    if not parts:
        return corpus.spark.createDataFrame([], "fi int, ci int, kind string, tier string, n bigint, n_short bigint, shortest double")
    return _union(parts).select(*KEY, "kind", "tier", "n", "n_short", "shortest")


def _classes(table: DataFrame, columns: list[str], part: dict) -> DataFrame:
    """The table with the class of each row's shape; rows are known by recording and segment."""
    name = F.concat_ws(":", "fi", "ci", "si")
    clusters = part["kMeans"]["n_cluster"] if part["mtd"].lower() == "kmeans" else None
    found = prosody.contour_classes(table.withColumn("__key", name), "__key", columns, part["bandwidth"], clusters)
    return table.withColumn("__key", name).join(found.select("__key", "class"), "__key", "left").drop("__key")


def process(spark: SparkSession, settings: dict | str) -> dict[str, DataFrame]:
    """Tables by name (``glob``, ``loc``, ``bnd``, ``gnl_f0``, ``gnl_f0_file``, ``gnl_en``,
    ``rhy_f0``, ``rhy_en``, ``voice``, ``voice_file``, ``summary``) for the stages that are on, each with
    the recording's stem and groups; written as CSV if ``do_export`` is on."""
    conf = config.load(settings)
    on, fs, styl = conf["navigate"], conf["fsys"], conf["styl"]
    corpus = Corpus(spark, conf)
    _augmented(corpus, on)
    contour, out = corpus.contour, {}
    if any(on[k] for k in ("do_augment_chunk", "do_augment_syl", "do_augment_glob", "do_augment_loc")):
        out["tiers"] = corpus.items
    if on["do_diagnosis"]:
        out["diagnosis"] = saved(diagnosis(corpus), "diagnosis")
    if on["do_styl_glob"]:
        phrases = _renumbered(_union(corpus.tier(n) for n in fs["glob"]["tier"]), "on")
        out["glob"] = saved(prosody.global_lines(contour, phrases, **_lines(styl["glob"]), raw=("xmin", "xmax")), "glob")
        if on["do_clst_glob"]:
            out["glob"] = saved(_classes(out["glob"], [f"{styl['register']}_c1"], conf["clst"]["glob"]), "glob")
    if on["do_styl_loc"]:
        order, groups = styl["loc"]["ord"], saved(local_groups(corpus, phrases), "groups")
        out["loc"] = saved(prosody.local_shapes(contour, groups, phrases, order, styl["register"], **_lines(styl["glob"])), "loc")
        if on["do_styl_loc_ext"]:
            more = prosody.local_extended(contour, groups, phrases, order, ("raw_on", "raw_off"), **_lines(styl["glob"]))
            out["loc"] = saved(out["loc"].join(more, [*KEY, "si"], "left"), "loc-ext")
        if on["do_clst_loc"]:
            out["loc"] = saved(_classes(out["loc"], [f"c{k}" for k in range(order + 1)], conf["clst"]["loc"]), "loc")
    if on["do_styl_bnd"]:
        out["bnd"] = saved(_per_tier(conf, "bnd", lambda n: prosody.boundaries(contour, corpus.tier(n).select(*KEY, "si", "on", "off"), corpus.chunks(), **_lines(styl["bnd"]), norm=styl["bnd"]["win"])), "bnd")
    if on["do_styl_gnl_f0"]:
        out["gnl_f0"] = saved(_per_tier(conf, "gnl_f0", lambda n: prosody.general(contour, corpus.windows(n))), "gnl_f0")
        out["gnl_f0_file"] = saved(prosody.whole_file(contour), "gnl_f0_file")
    if on["do_styl_rhy_f0"]:
        rates = [(n, corpus.tier(n)) for n in fs["rhy_f0"]["tier_rate"]]
        out["rhy_f0"] = saved(_per_tier(conf, "rhy_f0", lambda n: _rhythm(contour, corpus.tier(n), styl["rhy_f0"], rates)), "rhy_f0")
    if on["do_styl_gnl_en"] or on["do_styl_rhy_en"]:
        sounds = corpus.samples()
        if on["do_styl_gnl_en"]:
            part = styl["gnl_en"]
            out["gnl_en"] = saved(_per_tier(conf, "gnl_en", lambda n: _union(prosody.energy_features(x, rate, contour, corpus.windows(n), part["sts"], part["win"]) for x, rate in sounds)), "gnl_en")
        if on["do_styl_rhy_en"]:
            part = styl["rhy_en"]["sig"]
            energy = _union(prosody.energy_contour(x, rate, part["sts"], part["win"]) for x, rate in sounds)
            rates = [(n, corpus.tier(n)) for n in fs["rhy_en"]["tier_rate"]]
            out["rhy_en"] = saved(_per_tier(conf, "rhy_en", lambda n: _rhythm(energy, corpus.tier(n), styl["rhy_en"], rates)), "rhy_en")
    if on["do_styl_voice"]:
        pulses, part = saved(corpus.pulses(), "pulses"), styl["voice"]
        if fs["aud"]["dir"]:
            pulses = saved(_union(prosody.pulse_levels(pulses.join(x.select(*KEY).distinct(), KEY, "left_semi"), x, rate) for x, rate in corpus.samples()), "pulse-levels")
        out["voice"] = saved(_per_tier(conf, "voice", lambda n: prosody.voice(pulses, corpus.windows(n).select(*KEY, "si", "on", "off"), **part)), "voice")
        out["voice_file"] = saved(prosody.voice(pulses, **part), "voice_file")
    feats = {n: df for n, df in out.items() if n not in ("tiers", "diagnosis")}
    if fs["export"]["summary"] and feats:
        out["summary"] = saved(prosody.summary(feats, {n: fs[n]["tier"] for n in feats if fs.get(n, {}).get("tier") and "tier" in feats[n].columns}), "summary")
    out = {name: df.join(corpus.recordings.withColumnRenamed("stem", "stm"), "fi", "left") for name, df in out.items()}
    if on["do_export"]:
        export(out, fs["export"])
    return out


def export(tables: dict[str, DataFrame], part: dict) -> None:
    """Each table as a folder of CSV beside a script that reads it."""
    for name, df in tables.items():
        path = f"{part['dir']}/{part['stm']}.{name}.csv"
        if part["csv"]:
            sinks.write_table(df, path, part["sep"])
            script = df.sparkSession.createDataFrame([(sinks.r_script(df, path, part["sep"]),)], "content string")
            sinks.write_contents(script.coalesce(1), f"{part['dir']}/{part['stm']}.{name}.R")
