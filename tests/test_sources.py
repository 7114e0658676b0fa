"""Readers and writers: round trips."""

import wave

import numpy as np
import pytest

from melisma import sources
from melisma.sources import audio, sinks
from melisma.sources.annotations import parse_partitur, parse_textgrid, parse_tier_xml

ITEMS = [("f", "W", "IntervalTier", 0, 0.0, 0.5, 'say "a" & <b>', 2.0), ("f", "W", "IntervalTier", 1, 0.5, 2.0, "", 2.0), ("f", "P", "TextTier", 0, 0.25, 0.25, "x [1] 3.5", 2.0)]


@pytest.fixture()
def items(spark):
    return spark.createDataFrame(ITEMS, "path string, tier string, class string, item_idx int, xmin double, xmax double, label string, file_end double")


@pytest.mark.parametrize("short", [False, True])
def test_textgrid_round_trip(items, short):
    content = sinks.textgrid(items, short).first()["content"]
    assert sorted(parse_textgrid(content)) == sorted(r[1:] for r in ITEMS)


def test_tier_xml_round_trip(items):
    got = sorted(r[:6] for r in parse_tier_xml(sinks.tier_xml(items).first()["content"]))
    assert got == sorted((t, c, i, a, b, label or "x") for _, t, c, i, a, b, label, _ in ITEMS)


def test_partitur_round_trip(items):
    got = {(r[0], r[1], r[2]): r[3:6] for r in parse_partitur(sinks.partitur(items.where("label <> ''"), 100).first()["content"])}
    assert got["P", "TextTier", 0] == (0.25, 0.25, "x [1] 3.5")
    assert got["W", "IntervalTier", 0][0] == 0.0 and abs(got["W", "IntervalTier", 0][1] - 0.5) < 0.02
    fields = "LHD: x\nSAM: 1000\nLBD:\nORT: 0 word\nMAU: 0 100 0 a\nMAU: 105 95 0 b\nPRB: 50 0 H*\nTRN: 0 200 0,1 all of it"
    rows = list(parse_partitur(fields, snap=True))
    assert rows[0][3:6] == (None, None, "word") and rows[1][3:6] == (0.0, 0.099, "a") and rows[2][3] == 0.099 and rows[3][3:6] == (0.05, 0.05, "H*")


def test_tables(spark, tmp_path):
    (tmp_path / "a_b.f0").write_text("0.01 100.004 0\n0.02 nan 7\n\n0.03\t0 8\n")
    (tmp_path / "a_b.pulse").write_text("0.1 -1\n0.2 0.0\n0.3 0.15\n")
    (tmp_path / "a_b.lab").write_text("0 1.5 some words\n1.5 2\n")
    (tmp_path / "a_b.kv").write_text("k v w\nlonely\n")
    path = str(tmp_path)
    assert sorted((r["ci"], r["t"], r["y"]) for r in sources.read_contour(spark, path, "*.f0").collect()) == [(0, 0.01, 100.0), (0, 0.02, 0.0), (0, 0.03, 0.0), (1, 0.01, 0.0), (1, 0.02, 7.0), (1, 0.03, 8.0)]
    assert sorted((r["ci"], r["t"]) for r in sources.read_pulses(spark, path, "*.pulse").collect()) == [(0, 0.1), (0, 0.2), (0, 0.3), (1, 0.15)]
    assert sorted(tuple(r)[1:] for r in sources.read_labels(spark, path, "*.lab").collect()) == [(0.0, 1.5, "some words"), (1.5, 2.0, "")]
    assert [tuple(r)[1:] for r in sources.read_key_values(spark, path, glob="*.kv").collect()] == [("k", "v w")]
    assert sources.read_lines(spark, path, r"\s+", "*.kv").count() == 2
    row = sources.recordings(sources.read_lines(spark, path, glob="*.kv"), ["one", "two", "three"]).first()
    assert (row["stem"], row["fi"], row["grp_one"], row["grp_two"], row["grp_three"]) == ("a_b", 0, "a", "b", None)


def test_wav(spark, tmp_path, monkeypatch):
    x = (np.arange(100).reshape(-1, 2) * 300 - 16000).astype("<i2")
    with wave.open(str(tmp_path / "s.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(1000)
        w.writeframes(x.tobytes())
    blocks = sources.read_wav(spark, str(tmp_path))
    rows = sorted((r["ci"], r["i"], r["x"]) for r in audio.samples(blocks).collect())
    assert np.allclose([v for *_, v in rows], np.concatenate([x[:, 0], x[:, 1]]) / 32768)
    assert abs(sum(r["x"] for r in audio.samples(blocks, center=True).collect())) < 1e-3


def test_write_table(items, tmp_path, spark):
    sinks.write_table(items.drop("item_idx"), str(tmp_path / "t"))
    back = spark.read.csv(str(tmp_path / "t"), header=True)
    assert back.columns == sorted(items.drop("item_idx").columns) and back.count() == 3
    script = sinks.r_script(items.select("tier", "xmin"), "t.csv")
    assert "tier='factor'" in script and "xmin='numeric'" in script
    contour = spark.createDataFrame([(0, 0, 0.01, 1.0), (0, 1, 0.01, 2.5)], "fi int, ci int, t double, y double")
    assert sinks.contour_lines(contour, 2).first()["line"] == "0.01 1.00 2.50"


def test_export_and_saved_tables_come_back(spark, tmp_path):
    from melisma import storage
    from melisma.sources import sinks, tables

    df = spark.createDataFrame([("a", 0, 1.5, None), ("b", 1, -2.0, 3.0)], "stm string, fi int, x double, y double")
    sinks.write_table(df, str(tmp_path / "t.csv"))
    got = sorted(tuple(r) for r in tables.read_export(spark, str(tmp_path / "t.csv")).select("stm", "fi", "x", "y").collect())
    assert got == [("a", "0", 1.5, None), ("b", "1", -2.0, 3.0)]
    storage.save_tables({"one": df}, str(tmp_path / "state"))
    assert storage.load_tables(spark, str(tmp_path / "state"), ["one"])["one"].count() == 2
