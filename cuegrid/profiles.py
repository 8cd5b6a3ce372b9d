"""Readability profiles and rule switches; defaults are the house profile."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path

from cuegrid import constants as K


@dataclass(frozen=True)
class Profile:
    max_lines: int = K.MAX_LINES
    preferred_cps: float = K.PREFERRED_CPS
    hard_max_cps: float = K.HARD_MAX_CPS
    preferred_cpl: int = K.PREFERRED_CPL
    hard_max_cpl: int = K.HARD_MAX_CPL
    min_duration_ms: int = K.MIN_DURATION_MS
    min_gap_ms: int = K.MIN_GAP_MS
    scene_min_cues: int = K.SCENE_MIN_CUES
    scene_max_cues: int = K.SCENE_MAX_CUES
    review_below: int = K.REVIEW_BELOW
    memory_threshold: float = 0.92
    technical: bool = True
    linguistic: bool = True
    semantic: bool = True


HOUSE = Profile()


def load_profile(path: str | Path | None, name: str = "house_standard") -> Profile:
    """The named profile of a JSON or YAML file ({"profiles": {name: {...}}, "qc": {...}}); the house profile where the file is missing, unreadable or not of that shape.  YAML needs its library."""
    if path is None or not Path(path).is_file():
        return HOUSE
    try:
        text = Path(path).read_text(encoding="utf-8")
        if str(path).endswith((".yaml", ".yml")):
            import yaml

            data = yaml.safe_load(text)
        else:
            data = json.loads(text)
        found = {**data.get("profiles", {}).get(name, {}), **{k: v for k, v in data.get("qc", {}).items() if isinstance(v, bool)}}
        kinds = {f.name: type(getattr(HOUSE, f.name)) for f in fields(Profile)}
        return Profile(**{k: kinds[k](v) for k, v in found.items() if k in kinds})
    except (OSError, ValueError, TypeError, AttributeError, ImportError):
        return HOUSE
