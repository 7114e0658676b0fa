"""Detectors on signals whose pauses and syllables are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from melisma.operators import detect
from melisma.sources import audio

RATE = 8000
BLOCKS = "path string, ci int, rate int, first bigint, samples array<float>"


def blocks(spark, x, path="a"):
    return spark.createDataFrame([(path, 0, RATE, k, x[k : k + audio.BLOCK].tolist()) for k in range(0, len(x), audio.BLOCK)], BLOCKS)


@pytest.fixture(scope="module")
def speech():
    """Two stretches of a modulated tone (five beats a second) around a pause; the
    second lies across a border of blocks."""
    t = np.arange(0, 12 * RATE) / RATE
    x = 0.5 * np.sin(2 * np.pi * 500 * t) * (0.55 - 0.45 * np.cos(2 * np.pi * 5 * t))
    x[(t >= 5) & (t < 6.5)] = 0
    return x + 1e-4 * np.random.default_rng(0).normal(size=len(t))


def test_zero_phase_filter():
    t = np.arange(4 * RATE) / RATE
    slow, fast = np.sin(2 * np.pi * 300 * t), np.sin(2 * np.pi * 3000 * t)
    assert np.allclose(detect.zero_phase(slow + fast, RATE, None, 1000)[800:-800], slow[800:-800], atol=0.01)
    assert np.allclose(detect.zero_phase(slow + fast, RATE, 1500, None)[800:-800], fast[800:-800], atol=0.01)
    assert np.allclose(detect.zero_phase(slow + fast, RATE, 200, 500)[800:-800], slow[800:-800], atol=0.02)
    # An edge of a filter run both ways is at half the amplitude.
    assert detect.zero_phase_gain(np.array([1000.0]), RATE, None, 1000, 5)[0] == pytest.approx(0.5)
    assert len(detect.zero_phase(np.array([1.0]), RATE, None, 1000)) == 1


def test_frames_match_brute_force(spark, speech):
    got = detect.frames(blocks(spark, speech), 0.05, 0.1, 1.0).toPandas().sort_values("n")
    at = np.arange(1, len(speech), 400)
    assert got["n"].tolist() == list(range(len(at))) and np.allclose(got["t"], at / RATE)
    for column, half in (("e", 400), ("e_ref", 4000)):
        want = []
        for c in at:
            on, off = max(0, c - half), min(c + half, len(speech))
            short = 2 * half - 1 - (off - on)
            if short > 0:
                on, off = (max(0, on - short), off) if on > 0 else (on, min(len(speech), off + short))
            want.append(np.sqrt(np.mean(speech[on:off] ** 2)))
        assert np.allclose(got[column], want, atol=1e-7), column


def test_frames_do_not_depend_on_blocks(spark, speech, monkeypatch):
    columns = ["n", "t", "e", "e_ref", "e_next"]
    whole = detect.frames(blocks(spark, speech), 0.03, 0.08, 0.15, 200, 3000).toPandas().sort_values("n")[columns]
    monkeypatch.setattr(detect, "BLOCK", 4096)
    monkeypatch.setattr(audio, "BLOCK", 4096)
    cut = detect.frames(blocks(spark, speech), 0.03, 0.08, 0.15, 200, 3000).toPandas().sort_values("n")[columns]
    assert np.allclose(whole.to_numpy(float), cut.to_numpy(float), atol=1e-4)


def test_loud_half(spark, speech):
    row = detect.loud_rms(blocks(spark, speech)).first()
    size = np.abs(speech)
    assert row["end"] == 12.0
    assert row["loud"] == pytest.approx(np.sqrt(np.mean(speech[size > np.median(size)] ** 2)), rel=1e-3)


def test_pauses_and_chunks(spark, speech):
    rows = blocks(spark, speech).unionByName(blocks(spark, speech[: 2 * RATE], "b"))
    found = detect.pauses(rows).cache()
    got = found.collect()
    assert len(got) == 1 and got[0]["path"] == "a"
    assert got[0]["on"] == pytest.approx(5.0, abs=0.15) and got[0]["off"] == pytest.approx(6.5, abs=0.15)
    spans = sorted((r["path"], round(r["on"]), round(r["off"])) for r in detect.chunks(found, detect.loud_rms(rows)).collect())
    assert spans == [("a", 0, 5), ("a", 6, 12), ("b", 0, 2)]
    assert detect.strongest_pauses(found, 1).count() == 1
    # More pauses are found by raising the threshold, down to the beats' valleys.
    assert detect.pauses(rows.where("path = 'a'"), least=5, min_pause=0.0, min_chunk=0.0).count() >= 5


def test_nuclei(spark, speech):
    parents = spark.createDataFrame([("a", 0, 0, 0.0, 5.0), ("a", 0, 1, 6.5, 12.0)], "path string, ci int, chunk int, on double, off double")
    tops, cuts = detect.nuclei(blocks(spark, speech), parents)
    by_chunk = {r["chunk"]: r for r in tops.groupBy("chunk").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("t")).alias("ts")).collect()}
    # Beats peak at 0.1, 0.3, ...: 25 in the first stretch, 27 or 28 in the second.
    assert by_chunk[0]["n"] == 25 and by_chunk[1]["n"] in (27, 28)
    assert np.allclose(by_chunk[0]["ts"], 0.1 + 0.2 * np.arange(25), atol=0.035)
    ends = {r["chunk"]: r["t"] for r in cuts.groupBy("chunk").agg(F.max("t").alias("t")).collect()}
    assert ends == {0: 5.0, 1: 12.0}
    assert cuts.where("chunk = 0").count() == 25


def test_empty_audio(spark):
    none = spark.createDataFrame([], BLOCKS)
    assert detect.pauses(none).count() == 0 and detect.loud_rms(none).count() == 0
