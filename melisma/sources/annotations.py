"""Annotation files: TextGrid (long and short), Partitur, tier XML."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIER_SCHEMA = "path string, tier string, class string, item_idx int, xmin double, xmax double, label string, file_end double"
INTERVALS, POINTS = "IntervalTier", "TextTier"
#: Partitur tiers of events with a word reference, whose lines look like those of intervals.
EVENT_TIERS = {"PRB", "LBP", "LBG", "PRM"}

#: A value of a TextGrid: a string, the flag, or a number that is no list index.
_VALUE = re.compile(r'"((?:[^"]|"")*)"|(<exists>|<absent>)|(?<![\w\[.])([-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)(?![\w\]])')


def parse_textgrid(text: str) -> Iterator[tuple]:
    """Items ``tier, class, idx, xmin, xmax, label, file_end``.

    The long layout is the short one with names before the values, so both are read
    as one stream of values; a point has its time in ``xmin`` and ``xmax``.
    """
    values = [m.group(1).replace('""', '"') if m.group(1) is not None else (m.group(2) or float(m.group(3))) for m in _VALUE.finditer(text)]
    it = iter(values)
    if [next(it, None), next(it, None)] != ["ooTextFile", "TextGrid"]:
        raise ValueError("not a TextGrid")
    next(it, None)
    end, flag = next(it, 0.0), next(it, None)
    if flag != "<exists>":
        return
    for _ in range(int(next(it, 0))):
        kind, name, _, _, n = (next(it, None) for _ in range(5))
        for i in range(int(n or 0)):
            if kind == INTERVALS:
                a, b, label = next(it), next(it), next(it)
            else:
                a = b = next(it)
                label = next(it)
            yield name, kind, i, a, b, label, end


def parse_partitur(text: str, snap: bool = False) -> Iterator[tuple]:
    """Items of a Partitur file; samples become seconds by the header's ``SAM``.

    A line's fields after the tier's name tell its class: a word reference and a
    label (1), start, duration and label (2), start and label (3), start, duration,
    reference and label (4), start, reference and label (5).  With ``snap`` an
    interval of class 4 begins where the one before ended.
    """
    rate, counts, last = 0.0, {}, {}
    number = lambda x: bool(re.fullmatch(r"-?\d+", x))
    reference = lambda x: bool(re.fullmatch(r"-?\d+(?:[,;]-?\d+)*", x))
    for line in text.splitlines():
        name, _, rest = line.partition(":")
        f = rest.split()
        if name == "SAM" and f:
            rate = float(f[0])
        if name in ("LHD", "SAM", "LBD", "SNB", "SBF", "SSB", "NCH", "SPN", "REP", "VOL") or not f or not rate:
            continue
        i = counts.get(name, 0)
        if len(f) >= 4 and number(f[0]) and number(f[1]) and reference(f[2]):
            on, off, label = int(f[0]) / rate, (int(f[0]) + int(f[1]) - 1) / rate, " ".join(f[3:])
            if snap and name in last:
                on = last[name]
            last[name] = off
        elif len(f) >= 3 and number(f[0]) and number(f[1]) and int(f[1]) >= 0 and name not in EVENT_TIERS:
            on, off, label = int(f[0]) / rate, (int(f[0]) + int(f[1]) - 1) / rate, " ".join(f[2:])
        elif len(f) >= 3 and number(f[0]) and reference(f[1]):
            on = off = int(f[0]) / rate
            label = " ".join(f[2:])
        elif len(f) >= 2 and reference(f[0]):
            on = off = None
            label = " ".join(f[1:])
        else:
            continue
        counts[name] = i + 1
        yield name, POINTS if on == off else INTERVALS, i, on, off, label, None


def parse_tier_xml(text: str) -> Iterator[tuple]:
    """Items of ``<annotation><tiers><tier><name/><items><item>``, with ``label``
    and ``t`` or ``t_start, t_end``."""
    for tier in ElementTree.fromstring(text).iter("tier"):
        name = tier.findtext("name") or ""
        for i, item in enumerate(tier.iter("item")):
            at = item.findtext("t")
            on, off = (at, at) if at is not None else (item.findtext("t_start"), item.findtext("t_end"))
            yield name, POINTS if at is not None else INTERVALS, i, float(on), float(off), item.findtext("label") or "", None


def _read(spark: SparkSession, path: str, glob: str | None, parse) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TIER_SCHEMA.split(", ")]
        for frame in frames:
            for p, text in zip(frame["path"], frame["value"], strict=True):
                yield pd.DataFrame([(p, *row) for row in parse(text)], columns=names)

    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(run, TIER_SCHEMA)


def read_textgrid(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    return _read(spark, path, glob, parse_textgrid)


def read_partitur(spark: SparkSession, path: str, glob: str | None = None, snap: bool = False) -> DataFrame:
    return _read(spark, path, glob, lambda text: parse_partitur(text, snap))


def read_tier_xml(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    return _read(spark, path, glob, parse_tier_xml)
