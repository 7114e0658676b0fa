"""Settings to tables, against published values of one recording."""

import json
import wave
from pathlib import Path

import numpy as np
import pytest

from melisma import config, engine

from test_prosody import COURSE, EXTENDED, FIRST_ACCENT, FIRST_PHRASE, FIXTURES, JITTER, PEAKS, RHYTHM, SECOND_PHRASE, SHAPES, same

STAGES = ["do_styl_glob", "do_styl_loc", "do_styl_loc_ext", "do_styl_gnl_f0", "do_styl_bnd", "do_styl_rhy_f0", "do_styl_voice"]
LINES = {"decl_win": 0.1, "prct": {"bl": 5, "tl": 95}}


def settings(out: str) -> dict:
    place = {"dir": FIXTURES}
    tiers = {"glob": {"tier": "IP"}, "loc": {"tier_ag": "WRD", "tier_acc": ["ACC"]}, "bnd": {"tier": ["WRD"]}, "gnl_f0": {"tier": ["ACC"]}, "rhy_f0": {"tier": ["IP"], "tier_rate": ["ACC"]}, "voice": {"tier": ["IP"]}}
    return {
        "navigate": {s: True for s in [*STAGES, "do_export"]},
        "fsys": {"f0": place, "pulse": place, "annot": place, "export": {"dir": out, "stm": "t", "summary": True}, "grp": {"lab": ["dialog", "turn", "spk"]}, "label": {"pau": "<p:>"}, **tiers},
        "preproc": {"point_win": 0.2},
        "styl": {"glob": LINES, "bnd": {**LINES, "win": 0.6}, "rhy_f0": {"rhy": {"rmo": True}}},
    }


def test_settings_merge(tmp_path):
    got = config.load({"fsys": {"glob": {"tier": "IP"}}, "preproc": {"out": {"f": 2}}})
    assert got["fsys"]["glob"]["tier"] == ["IP"] and got["preproc"]["out"] == {"f": 2, "m": "mean"} and got["fs"] == 100
    file = tmp_path / "s.json"
    file.write_text(json.dumps({"fsys": {"f0": {"dir": "../in"}}}))
    assert config.load(str(file))["fsys"]["f0"]["dir"] == str((tmp_path / "../in").resolve())
    assert config.DEFAULTS["fsys"]["f0"]["dir"] == ""
    with pytest.raises(ValueError):
        config.load({"navigate": {"do_clst_loc": True}})


def test_process(spark, tmp_path):
    tables = engine.process(spark, settings(str(tmp_path)))
    rows = {name: {r["si"] if "si" in df.columns else 0: r for r in df.collect()} for name, df in tables.items()}
    # The second phrase begins after the last pulse, so voice has one row.
    assert {n: len(r) for n, r in rows.items()} == {"glob": 2, "loc": 6, "gnl_f0": 6, "gnl_f0_file": 1, "bnd": 14, "rhy_f0": 2, "voice": 1, "voice_file": 1, "summary": 1}
    same(rows["glob"][0], FIRST_PHRASE)
    same(rows["glob"][1], SECOND_PHRASE)
    same(rows["gnl_f0"][0], FIRST_ACCENT)
    for si, want in SHAPES.items():
        same(rows["loc"][si], want)
    same(rows["rhy_f0"][0], RHYTHM)
    same(rows["rhy_f0"][0], {"ACC_rate": 1.3636363636363638, "ACC_prop": 0.45956326443029033, "ACC_dgm": 0.25025767882910754})
    same(rows["rhy_f0"][0], PEAKS)
    same(rows["voice_file"][0], JITTER)
    same(rows["voice_file"][0], COURSE)
    for si, want in EXTENDED.items():
        same(rows["loc"][si], want)
    assert rows["glob"][0]["grp_turn"] == "turnId" and rows["glob"][0]["stm"] == "dialogId_turnId_spkId"
    written = {p.name for p in Path(tmp_path).iterdir()}
    assert written == {f"t.{n}.{e}" for n in rows for e in ("csv", "R")}
    assert spark.read.csv(str(tmp_path / "t.loc.csv"), header=True).count() == 6


def test_settings_without_effect_are_named():
    with pytest.warns(UserWarning, match=r"navigate.do_plot, styl.glob.foo"):
        config.load({"navigate": {"do_plot": True}, "styl": {"glob": {"foo": 1}}})
    with pytest.warns(UserWarning, match="100 samples"):
        config.load({"fs": 50})
    assert config.load({"navigate": {"do_voice": True}})["navigate"]["do_styl_voice"]


def test_base_value_of_a_group(spark, tmp_path):
    """Two recordings of a speaker share a base value, a third has its own."""
    place = tmp_path / "in"
    place.mkdir()
    for name, level in (("a_x", 100), ("b_x", 200), ("c_y", 300)):
        (place / f"{name}.f0").write_text("".join(f"{t / 100:.2f} {level + t % 7}\n" for t in range(1, 120)))
    conf = config.load({"fsys": {"f0": {"dir": str(place)}, "grp": {"lab": ["file", "spk"]}}, "preproc": {"base_prct_grp": {"1": "spk"}}})
    got = engine.Corpus(spark, conf).contour.groupBy("fi").agg({"base": "max"}).orderBy("fi").collect()
    assert got[0][1] == got[1][1] == pytest.approx(100, abs=3) and got[2][1] == pytest.approx(300, abs=3)


def test_diagnosis(spark):
    fs = {"f0": {"dir": FIXTURES}, "annot": {"dir": FIXTURES}, "label": {"pau": "<p:>"}, "glob": {"tier": ["IP"]}, "bnd": {"tier": ["none", "WRD"]}}
    got = {r["tier"]: r for r in engine.process(spark, {"navigate": {"do_diagnosis": True}, "fsys": fs})["diagnosis"].collect()}
    assert (got["IP"]["n"], got["none"]["n"], got["none"]["fi"], got["WRD"]["n"], got["WRD"]["n_short"]) == (2, 0, None, 15, 0)


def test_augmentation(spark, tmp_path):
    """Words that are apart are cut into phrases, and each phrase's words get accents;
    the tiers are there for the stages that follow."""
    place = {"dir": FIXTURES}
    fs = {
        "f0": place, "annot": place, "label": {"pau": "<p:>"}, "export": {"dir": str(tmp_path)}, "glob": {"tier": ["NEW_1"]},
        "augment": {"glob": {"tier_out_stm": "NEW", "tier": ["WRD"]}, "loc": {"tier_out_stm": "PROM", "tier_acc": ["ACC"], "tier_ag": ["WRD"]}},
    }
    wgt = {"glob": {"std": {"p": 1, "ml": {"r": 1, "rms": 1}}, "win": {"ml": {"d_m": 1}}}, "loc": {"acc": {"c": [1, 1, 1, 1]}, "gnl_f0": {"sd": 1}, "gst": {"ml": {"rms": 1}}}}
    for unit in ("file", "batch"):
        conf = {"navigate": {"do_augment_glob": True, "do_augment_loc": True, "do_styl_glob": True}, "fsys": fs, "preproc": {"point_win": 0.2}, "augment": {k: {"wgt": w, "unit": unit} for k, w in wgt.items()}}
        tables = engine.process(spark, conf)
        items = tables["tiers"].collect()
        words = sorted((round(r["xmin"], 2), round(r["xmax"], 2)) for r in items if r["tier"] == "WRD" and r["label"] and r["label"] != "<p:>")
        phrases = sorted((r["xmin"], r["xmax"]) for r in items if r["tier"] == "NEW_1")
        # Every phrase ends where a word or the recording does, and they follow each other.
        assert phrases and all(any(abs(b - w) < 1e-9 for _, w in words) or b == phrases[-1][1] for _, b in phrases)
        assert all(b <= c + 1e-9 for (_, b), (c, _) in zip(phrases, phrases[1:]))
        gaps = [a[1] for a, b in zip(words, words[1:]) if b[0] > a[1]]
        assert all(any(abs(g - b) < 0.5 for _, b in phrases) for g in gaps)
        accents, points = ({round(r["xmin"], 2) for r in items if r["tier"] == t} for t in ("PROM_1", "ACC"))
        assert accents and accents <= points
        assert tables["glob"].count() == len(phrases)


def test_augmentation_from_audio(spark, tmp_path):
    """Two stretches of noise that swells three times: two chunks of three syllables."""
    rate, rng = 8000, np.random.default_rng(1)
    x = np.zeros(int(4.6 * rate))
    for on in (0.5, 3.0):
        a, n = int(on * rate), int(0.75 * rate)
        x[a : a + n] = rng.normal(0, 0.2, n) * np.sin(np.pi * 4 * np.arange(n) / rate) ** 2
    with wave.open(str(tmp_path / "dialogId_turnId_spkId.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((x.clip(-1, 1) * 32767).astype("<i2").tobytes())
    fs = {"f0": {"dir": FIXTURES}, "aud": {"dir": str(tmp_path)}}
    items = engine.process(spark, {"navigate": {"do_augment_chunk": True, "do_augment_syl": True}, "fsys": fs})["tiers"].collect()
    chunks = sorted((r["xmin"], r["xmax"]) for r in items if r["tier"] == "CHUNK_1")
    nuclei = sorted(r["xmin"] for r in items if r["tier"] == "SYL_1")
    assert len(chunks) == 2 and chunks[0][0] < 0.8 < chunks[0][1] < 3.3 < chunks[1][1]
    swells = [on + 0.125 + 0.25 * k for on in (0.5, 3.0) for k in range(3)]
    assert nuclei and all(min(abs(t - s) for s in swells) < 0.08 for t in nuclei)


def test_energy_stage(spark, tmp_path):
    rate, place = 1000, {"dir": FIXTURES}
    x = np.sin(2 * np.pi * 50 * np.arange(4600) / rate) * np.linspace(0.2, 0.9, 4600)
    with wave.open(str(tmp_path / "dialogId_turnId_spkId.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((x * 32767).astype("<i2").tobytes())
    fs = {"f0": place, "annot": place, "aud": {"dir": str(tmp_path)}, "gnl_en": {"tier": ["ACC"]}, "label": {"pau": "<p:>"}}
    rows = sorted(engine.process(spark, {"navigate": {"do_styl_gnl_en": True}, "fsys": fs, "preproc": {"point_win": 0.2}})["gnl_en"].collect(), key=lambda r: r["si"])
    assert len(rows) == 6
    # The tone grows louder, and its balance is that of 50 Hz at this rate.
    assert [r["rms"] for r in rows] == sorted(r["rms"] for r in rows)
    want = 20 * np.log10(np.sqrt(1 + 0.95**2 - 2 * 0.95 * np.cos(2 * np.pi * 50 / rate)))
    assert all(r["sb"] == pytest.approx(want, abs=0.3) for r in rows)
    with pytest.raises(ValueError):
        engine.process(spark, {"navigate": {"do_styl_gnl_en": True}, "fsys": {**fs, "aud": {"dir": FIXTURES}}})
