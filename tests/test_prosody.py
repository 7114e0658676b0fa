"""Feature tables of one recording against published values (rtol 1e-5)."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from melisma import sources
from melisma.operators import interval
from melisma.plans import prosody

FIXTURES = str(Path(__file__).parent / "fixtures")

# Fixed values of the recording's feature tables.
FILE = {"bv": 79.33095238, "m": 2.8807882418, "sd": 1.8779992263, "med": 2.6588339612, "iqr": 2.5515078069, "max": 7.6505767379, "min": -4.0061926430, "maxpos": 0.2759381898, "dur": 4.53, "qi": 1.7489410116, "qf": -0.0099585020, "qb": None, "qm": 1.7489410116, "c0": 4.4621810095, "c1": -0.2191369060, "c2": -4.4105939670}
FIRST_ACCENT = {"m": 4.9613240572, "sd": 0.3610161360, "med": 5.0494701386, "iqr": 0.3400520354, "max": 5.3002878207, "min": 3.9952084026, "maxpos": 0.7619047619, "dur": 0.21, "m_nrm": 1.1896042446, "sd_nrm": 0.3427618230, "iqr_nrm": 0.1824643103, "maxpos_nrm": 1.2910052910, "dur_nrm": 0.35, "min_nrm": 2.1792021858, "qi": 0.9678783768, "qf": 1.2418185879, "qb": 1.0, "c0": 4.1235637187, "c1": 3.1765962286, "c2": -2.1966959290}
FIRST_PHRASE = {"bl_c0": 4.1897279464, "bl_c1": -4.334058652, "bl_drop": -4.343069176, "bl_m": 2.0226986203, "bl_rate": -0.984822942, "bl_r": 4.1897279464, "ml_c0": 5.0971812629, "ml_c1": -4.365653386, "tl_c0": 5.9899807970, "tl_c1": -4.633358836, "tl_m": 3.6733013789, "rng_c0": 1.8002528506, "rng_c1": -0.299300183, "rng_m": 1.6506027586, "tl_ml_cross_t": 3.3350069450, "tl_ml_cross_f0": -9.462303100, "ml_bl_cross_t": 28.721663239}
SECOND_PHRASE = {"bl_r": 0.1615726258, "ml_r": -0.714285956, "tl_r": -1.339380040, "rng_r": -1.500952666, "tl_ml_cross_t": None}
SHAPES = {
    0: {"c0": 0.5464442459, "c1": 1.3403022661, "c2": -1.707026741, "c3": 0.2634552787, "rms_c0": 1.0751767449, "rms_c1": 0.5593299356, "rms_c2": 0.1448358397, "rms_c3": 0.1383390483, "rmsd": 1.0777792635},
    1: {"c0": 0.4843351318, "c1": -3.454666750, "c2": 1.0271108457, "c3": 1.0333713095, "rms_c0": 1.8046819127, "rmsd": 1.9264964352},
}
EXTENDED = {
    0: {"bl_c0": 1.9190734071904765, "bl_rate": 11.084046974970045, "bl_sd": 0.1178137080770454, "ml_c0": 2.8720574207857146, "ml_rate": 8.718496452635328, "ml_sd": 0.09478187950003603, "tl_c0": 3.7452055708095235, "tl_rate": 6.103286130613511, "tl_sd": 0.0698331971617682, "rng_c0": 1.8261321636190473, "rng_rate": -4.980760844356536, "rng_sd": -0.04798051091527722, "res_bl_c0": 1.2489619696262078, "res_bl_c3": -0.16984845393163417, "res_ml_c2": -1.4541220429531143, "res_tl_c1": 1.7556303473862367, "res_rng_c0": 0.708283887855724, "res_rng_c3": -0.10075093046229452},
    1: {"bl_c1": -4.942156288550503, "bl_d_fin": -1.2010918825253616, "ml_sd": -0.123993006662245, "tl_rms": 1.8609312767960011, "rng_m": 1.5810610728409096, "res_bl_c0": 1.5540744682689753, "res_ml_c3": 1.640936928639058, "res_rng_c2": 0.5338065660584534},
    5: {"bl_m": 0.3531755246226413, "ml_m": 0.5914768166037736, "tl_m": 0.8361030913207542, "rng_m": 0.4829275666981132, "res_bl_c2": 0.5136940181010557, "res_tl_c3": 0.8273532617153844},
}
#: Published, of the first phrase's spectrum and of the recording's periods.
PEAKS = {"n_peak": 3, "ACC_dlm": 0.25025767882910754, "ACC_mae": 24.514758200106723}
COURSE = {"jit_c0": 0.03633476748155492, "jit_c1": 0.015359472650420957, "jit_c2": -0.00971392555942283, "jit_c3": -0.023499233181828134}
RHYTHM = {"sm1": 3.75250809446341, "sm2": 6.242448116608967, "sm3": -55.236690633641736, "f_max": 1.1133786848072562}
JITTER = {"jit": 0.03326791526224681, "jit_m": 0.010702931559633025, "jit_sd": 0.0012158815187002514}


def same(row, want):
    for k, v in want.items():
        assert row[k] is None if v is None else row[k] == pytest.approx(v, rel=1e-5, abs=1e-8), k


@pytest.fixture(scope="module")
def recording(spark):
    key = [F.lit(0).alias("fi"), F.lit(0).alias("ci")]
    items = sources.read_textgrid(spark, FIXTURES, "*.TextGrid").cache()
    f0 = sources.read_contour(spark, FIXTURES, "*.f0").withColumn("fi", F.lit(0))
    ends = items.agg(F.max("file_end").alias("end")).withColumn("fi", F.lit(0))
    contour = prosody.preprocess(f0, ends).cache()
    accents = items.where("tier = 'ACC'").select(*key, F.col("item_idx").alias("si"), F.col("xmin").alias("t"))
    phrases = items.where("tier = 'IP' AND label = 'x'").select(*key, (F.col("item_idx") - 1).alias("si"), F.round("xmin", 2).alias("on"), F.round("xmax", 2).alias("off"), "xmin", "xmax")
    words = items.where("tier = 'WRD' AND label <> ''").select(*key, F.round("xmin", 2).alias("on"), F.round("xmax", 2).alias("off"))
    chunks = f0.groupBy("fi", "ci").agg(F.min("t").alias("c_on"), F.max("t").alias("c_off"))
    return contour, accents, phrases, words, chunks


def test_tiers(recording):
    assert recording[1].count() == 6 and recording[2].count() == 2 and recording[3].count() == 15


def test_whole_file(recording):
    same(prosody.whole_file(recording[0]).first(), FILE)


def test_general_features(recording):
    contour, accents, _, _, chunks = recording
    rows = {r["si"]: r for r in prosody.general(contour, prosody.point_segments(accents, chunks, 0.2, 0.6)).collect()}
    assert len(rows) == 6
    same(rows[0], FIRST_ACCENT)


def test_global_lines(recording):
    rows = {r["si"]: r for r in prosody.global_lines(recording[0], recording[2], 0.1, 5.0, 95.0, ("xmin", "xmax")).collect()}
    same(rows[0], FIRST_PHRASE)
    same(rows[1], SECOND_PHRASE)


def test_local_shapes(recording):
    contour, accents, phrases, words, _ = recording
    center = accents.withColumn("center", F.round("t", 2))
    groups = interval.range_join(center, words, ["fi", "ci"], "center", "on", "off", 5.0, "inner").drop("t").withColumn("gi", F.lit(0))
    rows = {r["si"]: r for r in prosody.local_shapes(contour, groups, phrases, window=0.1, p_low=5.0, p_high=95.0).collect()}
    for si, want in SHAPES.items():
        same(rows[si], want)


def test_rhythm_and_jitter(recording, spark):
    rows = {r["si"]: r for r in prosody.rhythm(recording[0], recording[2]).collect()}
    same(rows[0], RHYTHM)
    pulses = sources.read_pulses(spark, FIXTURES, "*.pulse").withColumn("fi", F.lit(0))
    assert pulses.count() == 255
    same(prosody.voice(pulses).first(), JITTER)


def test_contour_classes_and_resynthesis(recording, spark):
    shapes = spark.createDataFrame([(i, float(i % 2) * 9 + 0.01 * i, 1.0) for i in range(20)], "k int, c0 double, c1 double")
    classes = {r["k"]: r["class"] for r in prosody.contour_classes(shapes, "k", ["c0", "c1"], 0.5).collect()}
    assert len(set(classes.values())) == 2 and all(classes[i] == classes[i % 2] for i in range(20))
    local = recording[0].where("i < 10").select("fi", "ci", "i", F.col("y").alias("fit"))
    rows = prosody.resynthesize(recording[0], local, F.lit(0.0), F.col("base")).collect()
    assert sum(r["y_hz"] > 0 for r in rows) == 10
