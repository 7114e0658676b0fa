"""Boundary, energy and summary tables against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from melisma.operators import windows
from melisma.plans import prosody

RATE = 1000


@pytest.fixture(scope="module")
def contour(spark):
    rng = np.random.default_rng(1)
    y = np.concatenate([5 - np.arange(200) / 50, 6 - np.arange(250) / 90]) + rng.normal(0, 0.2, 450)
    return spark.createDataFrame([(0, 0, i, i / 100, float(v), 80.0) for i, v in enumerate(y)], "fi int, ci int, i int, t double, y double, base double").cache()


@pytest.fixture(scope="module")
def tiers(spark):
    words = spark.createDataFrame([(0, 0, 0, 0.2, 0.9), (0, 0, 1, 0.9, 1.9), (0, 0, 2, 2.2, 3.1), (0, 0, 3, 3.3, 4.2)], "fi int, ci int, si int, on double, off double")
    chunks = spark.createDataFrame([(0, 0, 0.1, 2.0), (0, 0, 2.1, 4.4)], "fi int, ci int, c_on double, c_off double")
    return words, chunks


def test_boundary_sides(tiers):
    rows = {(r["si"], r["win"], r["side"]): (round(r["on"], 6), round(r["off"], 6)) for r in prosody.boundary_sides(*tiers, norm=1.0).collect()}
    assert len(rows) == 18
    assert rows[0, "std", 0] == (0.2, 0.9) and rows[0, "std", 1] == (0.9, 1.9)
    assert rows[1, "win", 0] == (1.4, 1.9) and rows[1, "win", 1] == (2.2, 2.7)
    assert rows[1, "trend", 0] == (0.1, 1.9) and rows[1, "trend", 1] == (2.2, 4.4)


def line(x, y):
    c = np.polyfit(x, y, 1) if len(x) > 1 else [0, y[0]]
    return c[0], np.polyval(c, x)


def test_boundaries(spark, contour, tiers):
    got = {r["si"]: r for r in prosody.boundaries(contour, *tiers).collect()}
    assert sorted(got) == [0, 1, 2]
    assert len(got[0]) == 3 + 3 * 4 * 19
    ml = windows.register_medians(contour, ["fi", "ci"], "i", "y", 5).toPandas().sort_values("i")["ml"].to_numpy()
    sides = prosody.slices(contour, prosody.boundary_sides(*tiers)).groupBy("si", "win", "side").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.max("p").alias("p")).collect()
    at = {(r["si"], r["win"], r["side"]): r for r in sides}
    for si in (0, 1, 2):
        for win in prosody.WINDOWS:
            a, b = at[si, win, 0], at[si, win, 1]
            ia, ib = np.arange(a["a"], a["b"] + 1), np.arange(b["a"], b["b"] + 1)
            sa, ya = line(np.linspace(0, 1, len(ia)), ml[ia])
            sb, yb = line(np.linspace(0, 1, len(ib)), ml[ib])
            kept = ia < ib[0]
            y, own = np.concatenate([ml[ia[kept]], ml[ib]]), np.concatenate([ya[kept], yb])
            sab, z = line(np.linspace(0, 1, len(y)), y)
            n = kept.sum()
            want = {
                "p": a["p"], "r": yb[0] - ya[-1], "d_o": ya[0] - yb[0], "d_m": ya.mean() - yb.mean(), "sd_prepost": sa - sb, "sd_pre": sab - sa, "sd_post": sab - sb,
                "rms": np.sqrt(np.mean((own - z) ** 2)), "rms_pre": np.sqrt(np.mean((own - z)[:n] ** 2)), "rms_post": np.sqrt(np.mean((own - z)[n:] ** 2)),
                "rmsR": np.sqrt(np.mean((z - y) ** 2) / np.mean((own - y) ** 2)), "corrD": (1 - np.corrcoef(own, z)[0, 1]) / 2,
                "aicI": 6 + len(y) * np.log(np.sum((z - y) ** 2)) - 12 - len(y) * np.log(np.sum((own - y) ** 2)),
            }
            for m, v in want.items():
                assert got[si][f"{win}_ml_{m}"] == pytest.approx(v, rel=1e-6, abs=1e-8), (si, win, m)


def test_boundaries_of_little(contour, tiers):
    words, chunks = tiers
    assert prosody.boundaries(contour, words.where("si = 0"), chunks).count() == 0
    assert prosody.boundaries(contour.where("i < 0"), words, chunks).count() == 0
    assert prosody.boundary_sides(words, chunks.where("c_on < 0")).count() == 18


@pytest.fixture(scope="module")
def sound():
    t = np.arange(3 * RATE) / RATE
    return np.sin(2 * np.pi * 40 * t) * (1 + 0.5 * np.sin(2 * np.pi * t))


def test_energy(spark, contour, sound):
    samples = spark.createDataFrame([(0, 0, i, float(v)) for i, v in enumerate(sound)], "fi int, ci int, i long, x double")
    frames = prosody.energy_contour(samples, RATE).toPandas().sort_values("i")
    weight = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(50) / 50)
    want = [np.sqrt(np.mean((sound[k : k + 50] * weight) ** 2)) for k in range(0, len(sound) - 50, 10)]
    assert len(frames) == len(want) and np.allclose(frames["y"], want)
    segments = spark.createDataFrame([(0, 0, 0, 0.5, 1.0, 0.3, 1.2)], "fi int, ci int, si int, on double, off double, nrm_on double, nrm_off double")
    row = prosody.energy_features(samples, RATE, contour, segments).first()
    x, around = sound[500:1001], sound[300:1201]
    emphasized = np.append(x[0], x[1:] - 0.95 * x[:-1])
    rms = lambda v: np.sqrt(np.mean(v**2))
    assert row["rms"] == pytest.approx(rms(x)) and row["rms_nrm"] == pytest.approx(rms(x) / rms(around))
    assert row["sb"] == pytest.approx(20 * np.log10(rms(emphasized) / rms(x)))
    assert -1 <= row["r_en_f0"] <= 1


def test_silence_has_no_balance(spark):
    samples = spark.createDataFrame([(0, i, 0.0) for i in range(9)], "fi int, i long, x double")
    row = prosody.spectral_balance(samples, ["fi"]).first()
    assert row["sb"] is None and row["rms"] == 0.0


def test_summary(spark):
    shapes = spark.createDataFrame([(0, 0, 0, 1.0, 0), (0, 0, 1, 3.0, 1), (1, 0, 0, 5.0, 1)], "fi int, ci int, si int, c0 double, class int").withColumn("tier", F.lit("ACC"))
    files = spark.createDataFrame([(0, 0, 80.0), (2, 0, 90.0)], "fi int, ci int, bv double")
    rows = {r["fi"]: r for r in prosody.summary({"loc": shapes, "gnl_f0_file": files}, {"loc": ["ACC", "SYL"]}).collect()}
    assert sorted(rows) == [0, 1, 2]
    assert (rows[0]["loc_ACC_c0_m"], rows[0]["loc_ACC_c0_sd"], rows[0]["loc_class_h"], rows[0]["gnl_f0_file_bv"]) == (2.0, 1.0, 1.0, 80.0)
    assert rows[1]["loc_class_h"] == 0.0 and rows[1]["loc_SYL_c0_m"] is None and rows[1]["gnl_f0_file_bv"] is None
    assert rows[2]["loc_ACC_c0_m"] is None and rows[2]["gnl_f0_file_bv"] == 90.0
    with pytest.raises(ValueError):
        prosody.summary({})
