"""Tracker parameters and the versioned configuration."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, fields

SCHEMA_VERSION = 1


@dataclass(frozen=True)
class TrackerConfig:
    """Defaults of the tracker; ``SHIPPED`` holds the values of the shipped configuration."""

    high_conf: float = 0.25
    low_conf: float = 0.08
    min_hits: int = 2
    max_predict_frames: int = 8
    max_missing_frames: int = 20
    base_gate_px: float = 70.0
    max_gate_px: float = 280.0
    gate_growth_px: float = 20.0
    velocity_gate_scale: float = 1.5
    tentative_gate_px: float = 150.0
    max_speed_px_per_frame: float = 0.0
    reference_frame_width: float = 1280.0
    require_motion_confirmation: bool = False
    motion_threshold_px: float = 5.0
    min_motion_speed_px: float = 0.0
    max_stationary_frames: int = 0
    unconfirmed_max_frames: int = 30
    max_output_tracks: int = 0
    impact_recovery_gate_px: float = 260.0
    impact_recovery_min_speed_px: float = 15.0
    prediction_min_confidence: float = 0.0
    fast_prediction_speed_px: float = 0.0
    fast_max_predict_frames: int = 3
    prediction_velocity_decay: float = 1.0
    confidence_decay: float = 0.82
    process_noise: float = 12.0
    measurement_noise: float = 4.0
    max_tracks: int = 16
    emit_tentative: bool = True

    def __post_init__(self):
        if not 0 <= self.low_conf <= self.high_conf <= 1:
            raise ValueError("0 <= low_conf <= high_conf <= 1 must hold")
        if not self.max_missing_frames >= self.max_predict_frames >= 0:
            raise ValueError("max_missing_frames >= max_predict_frames >= 0 must hold")


# The shipped desktop configuration.
SHIPPED = TrackerConfig(
    low_conf=0.15, base_gate_px=55.0, max_gate_px=180.0, gate_growth_px=15.0, velocity_gate_scale=0.8, max_speed_px_per_frame=120.0, require_motion_confirmation=True, motion_threshold_px=12.0,
    min_motion_speed_px=0.8, max_stationary_frames=30, prediction_min_confidence=0.15, fast_prediction_speed_px=40.0, prediction_velocity_decay=0.9, max_tracks=32, emit_tentative=False,
)


def _scalar(text: str):
    """A value of the block form: JSON where it is JSON, a list in brackets, else plain text without its quotes."""
    text = text.strip()
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text[0] == "[" and text[-1] == "]":
        return [_scalar(t) for t in text[1:-1].split(",") if t.strip()]
    if text[0] == text[-1] == "'" and len(text) > 1:
        return text[1:-1].replace("''", "'")
    try:
        return json.loads(text.lower() if text.lower() in ("true", "false") else text)
    except json.JSONDecodeError:
        return text


def parse(text: str) -> dict:
    """A configuration text as nested dictionaries: JSON, or YAML of mappings by indentation, scalars, lists in brackets and comments. Anything else is refused."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    root: dict = {}
    open_maps = [(-1, root)]
    for number, raw in enumerate(text.splitlines(), 1):
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if not line.strip() or line == "---":
            continue
        match = re.fullmatch(r"( *)([\w.-]+):(?: +(.*))?", line)
        if not match:
            raise ValueError(f"line {number} is no mapping: {raw!r}")
        depth, key, value = len(match[1]), match[2], match[3]
        while open_maps[-1][0] >= depth:
            open_maps.pop()
        if value is None:
            open_maps[-1][1][key] = {}
            open_maps.append((depth, open_maps[-1][1][key]))
        else:
            open_maps[-1][1][key] = _scalar(value)
    return root


def load(text: str) -> TrackerConfig:
    """The tracker of a configuration (``schema_version: 1``, ``tracker: ...``) in YAML or JSON; unknown names and other versions fail. Other sections are for ``parse``."""
    data = parse(text)
    if data.get("schema_version") != SCHEMA_VERSION:
        raise ValueError(f"schema_version must be {SCHEMA_VERSION}")
    values = data.get("tracker", {})
    unknown = set(values) - {f.name for f in fields(TrackerConfig)}
    if unknown:
        raise ValueError(f"unknown tracker parameters: {sorted(unknown)}")
    return TrackerConfig(**values)
