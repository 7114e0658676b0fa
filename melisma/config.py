"""Settings as a JSON tree: defaults, merging, and what stages need of each other."""

from __future__ import annotations

import copy
import json
import warnings
from pathlib import Path
from typing import Any

_LINES = {"decl_win": 0.1, "prct": {"bl": 10, "tl": 90}}
_RHYTHM = {"rhy": {"winparam": 1, "lb": 0, "ub": 10, "rmo": False, "peak_prct": 80, "wgt": {"rb": 1}}}
_FRAMES = {"sts": 0.01, "win": 0.05}

#: The default settings.
DEFAULTS: dict[str, Any] = {
    "fs": 100,
    "navigate": {
        "do_styl_glob": False, "do_styl_loc": False, "do_styl_loc_ext": False, "do_styl_gnl_f0": False, "do_styl_gnl_en": False, "do_styl_bnd": False,
        "do_augment_chunk": False, "do_augment_syl": False, "do_augment_glob": False, "do_augment_loc": False, "do_diagnosis": False,
        "do_styl_rhy_f0": False, "do_styl_rhy_en": False, "do_styl_voice": False, "do_clst_loc": False, "do_clst_glob": False, "do_export": False,
    },
    "fsys": {
        "f0": {"dir": "", "ext": "f0"}, "pulse": {"dir": "", "ext": "pulse"}, "aud": {"dir": "", "ext": "wav"}, "annot": {"dir": "", "ext": "TextGrid", "typ": "TextGrid"},
        "export": {"dir": "", "stm": "melisma", "sep": ",", "csv": True, "summary": False},
        "augment": {"chunk": {"tier_out_stm": "CHUNK"}, "syl": {"tier_out_stm": "SYL", "tier_parent": []}, "glob": {"tier_out_stm": "IP", "tier": [], "tier_parent": []}, "loc": {"tier_out_stm": "ACC", "tier_acc": [], "tier_ag": [], "tier_parent": []}},
        "pho": {"tier": [], "vow": "[AEIOUYaeiouy29@]"},
        "grp": {"lab": [], "sep": "_"}, "label": {"pau": "<P>", "chunk": "c", "syl": "s"}, "channel": {}, "chunk": {"tier": []},
        "glob": {"tier": []}, "loc": {"tier_ag": [], "tier_acc": []}, "bnd": {"tier": []}, "gnl_f0": {"tier": []}, "gnl_en": {"tier": []},
        "rhy_f0": {"tier": [], "tier_rate": []}, "rhy_en": {"tier": [], "tier_rate": []}, "voice": {"tier": []},
    },
    "preproc": {"base_prct": 5, "base_prct_grp": {}, "out": {"f": 3, "m": "mean"}, "nrm_win": 0.6, "point_win": 0.3},
    "styl": {
        "glob": _LINES, "loc": {"ord": 3}, "register": "ml", "bnd": _LINES | {"win": 1.0}, "gnl_en": _FRAMES,
        "rhy_f0": _RHYTHM, "rhy_en": _RHYTHM | {"sig": _FRAMES}, "voice": {"t_max": 0.02, "t_min": 0.0001, "fac_max": 1.3},
    },
    "clst": {"glob": {"mtd": "meanShift", "bandwidth": None, "kMeans": {"n_cluster": 3}}, "loc": {"mtd": "meanShift", "bandwidth": None, "kMeans": {"n_cluster": 5}}},
    "augment": {
        "chunk": {"e_rel": 0.1, "l": 0.1524, "l_ref": 5, "n": -1, "min_pau_l": 0.5, "min_chunk_l": 0.2, "margin": 0.0, "flt": {"f": 8000, "ord": 5}},
        "syl": {"e_rel": 1.07, "e_val": 0.91, "l": 0.08, "l_ref": 0.15, "d_min": 0.05, "e_min": 0.16, "flt": {"f": [200, 4000], "ord": 5}, "force": 0},
        "glob": {"measure": "abs", "prct": 95, "wgt": {}, "wgt_mtd": "silhouette", "cntr_mtd": "seed_prct", "min_l": 0.5, "use_gaps": True, "unit": "file", "heuristics": ""},
        "loc": {"measure": "abs", "prct": 80, "wgt": {}, "cntr_mtd": "split", "wgt_mtd": "corr", "min_l": 0.3, "min_l_a": 0.6, "max_l_na": 0.1, "acc_select": "max", "ag_select": "max", "unit": "file", "c_no_abs": False, "force": 0, "heuristics": ""},
    },
}

#: A stage and what must be on for it.
NEEDS = {"do_styl_loc": ["do_styl_glob"], "do_styl_loc_ext": ["do_styl_glob", "do_styl_loc"], "do_clst_loc": ["do_styl_loc"], "do_clst_glob": ["do_styl_glob"]}
#: Alternative names of switches.
ALIASES = {"do_voice": "do_styl_voice"}


def merged(given: dict, defaults: dict) -> dict:
    """``given`` with the defaults for what it leaves out, at every depth."""
    out = copy.deepcopy(defaults)
    for k, v in given.items():
        out[k] = merged(v, defaults[k]) if isinstance(v, dict) and isinstance(defaults.get(k), dict) else copy.deepcopy(v)
    return out


def without_effect(given: dict, known: dict, path: str = "") -> list[str]:
    """Paths of settings that no stage reads.  What lies in a tree of weights, and
    the keys of tables by name, are the user's own."""
    out = []
    for k, v in given.items():
        here = f"{path}.{k}" if path else k
        if k not in known:
            out.append(here)
        elif isinstance(v, dict) and isinstance(known[k], dict) and known[k]:
            out += without_effect(v, known[k], here)
    return out


def load(settings: dict | str) -> dict:
    """Settings from a tree or a JSON file, with defaults.

    Settings that have no effect are named in a warning, and so is a contour rate
    other than 100.

    Folders that are relative are taken from the file's place.  A tier may be given
    as one name or a list.  A stage whose needs are off is an error.
    """
    place = None
    if not isinstance(settings, dict):
        place, settings = Path(settings).resolve().parent, json.loads(Path(settings).read_text())
    nav = settings.get("navigate", {})
    settings = {**settings, "navigate": {ALIASES.get(k, k): v for k, v in nav.items()}} if nav else settings
    idle = without_effect(settings, DEFAULTS)
    if idle:
        warnings.warn(f"settings without effect: {', '.join(sorted(idle))}", stacklevel=2)
    if settings.get("fs", 100) != 100:
        warnings.warn("fs: contours are taken at 100 samples a second", stacklevel=2)
    out = merged(settings, DEFAULTS)
    for part in [*out["fsys"].values(), *out["fsys"]["augment"].values()]:
        if place and part.get("dir") and "://" not in part["dir"]:
            part["dir"] = str((place / part["dir"]).resolve())
        for k in ("tier", "tier_ag", "tier_acc", "tier_rate", "tier_parent"):
            if isinstance(part.get(k), str):
                part[k] = [part[k]] if part[k] else []
    for stage, needs in NEEDS.items():
        missing = [n for n in needs if out["navigate"].get(stage) and not out["navigate"].get(n)]
        if missing:
            raise ValueError(f"{stage} needs {', '.join(missing)}")
    return out
