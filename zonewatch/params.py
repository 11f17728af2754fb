"""Settings of the zone scan, with the documented defaults."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class ScanParams:
    # grid
    cell_px: int = 64
    overlap: float = 0.5
    occlusion_thr: float = 0.3
    occlusion_pad_px: float = 0.0
    # change gate
    change_on: bool = True
    thr: float = 6.0
    alpha: float = 0.05
    assume_clean_start: bool = False
    guard_frac: float = 0.45
    guard_spread: float = 0.8
    guard_min_visible: float = 0.6
    # decision
    mode: str = "classifier"
    dwell: int = 5
    min_hot: int = 1
    litter_thr: float = 0.6
    max_score: int = 24
    # confirmation and alerts
    n: int = 4
    m: int = 6
    alert_mode: str = "latch"
    cooldown_s: float = 1800.0
    rearm_scans: int = 4
    merge_radius: int = 2
    # clutter
    clutter_on: bool = True
    mute_after: int = 14_400
    mute_ratio: float = 0.98
    unmute_after: int = 20
    # camera movement
    shift_thr: float = 3.0
    stab_on: bool = False
    stab_max_px: float = 40.0
    stab_min_px: float = 3.0
    stab_fine_px: float = 8.0
    stab_max_deg: float = 3.0
    anchor_refresh: int = 20
    # detector
    verify_on: bool = False
    escalate_after: int = 0
    escalate_scale: float = 0.5

    @classmethod
    def production(cls) -> "ScanParams":
        """The shipped day profile."""
        return cls(cell_px=48, occlusion_pad_px=48, mode="change_only", dwell=3, min_hot=2, n=1, m=1,
                   mute_after=600, mute_ratio=0.95, unmute_after=10, shift_thr=12.0, stab_on=True,
                   verify_on=True, escalate_scale=0.4)

    @classmethod
    def from_config(cls, config: dict) -> "ScanParams":
        """From the nested configuration file; unknown keys are left alone."""
        found = {}
        for name, (group, key) in _CONFIG_KEYS.items():
            value = (config.get(group) or {}).get(key)
            if value is not None:
                found[name] = value
        kinds = {f.name: f.type for f in fields(cls)}
        cast = {"int": int, "float": float, "bool": bool, "str": str}
        return cls(**{k: cast[kinds[k]](v) for k, v in found.items()})


# Where each setting lives in a configuration file.
_CONFIG_KEYS = {
    "cell_px": ("grid", "cell_px"), "overlap": ("grid", "overlap"),
    "occlusion_thr": ("grid", "occlusion_thr"), "occlusion_pad_px": ("grid", "occlusion_pad_px"),
    "change_on": ("change", "enabled"), "thr": ("change", "thr"), "alpha": ("change", "alpha"),
    "assume_clean_start": ("change", "assume_clean_start"),
    "guard_frac": ("change", "global_change_frac"), "guard_spread": ("change", "global_change_spread"),
    "guard_min_visible": ("change", "global_change_min_visible"),
    "mode": ("decide", "mode"), "dwell": ("decide", "dwell_scans"), "min_hot": ("decide", "min_hot_cells"),
    "litter_thr": ("decide", "litter_thr"), "max_score": ("decide", "max_score_per_scan"),
    "n": ("confirm", "n"), "m": ("confirm", "m"),
    "alert_mode": ("alert", "mode"), "cooldown_s": ("alert", "cooldown_s"),
    "rearm_scans": ("alert", "rearm_scans"), "merge_radius": ("alert", "merge_radius_cells"),
    "clutter_on": ("clutter", "enabled"), "mute_after": ("clutter", "mute_after_scans"),
    "mute_ratio": ("clutter", "mute_ratio"), "unmute_after": ("clutter", "unmute_after_clean"),
    "shift_thr": ("scene_shift", "thr_px"),
    "stab_on": ("stabilize", "enabled"), "stab_max_px": ("stabilize", "max_px"),
    "stab_min_px": ("stabilize", "min_px"), "stab_fine_px": ("stabilize", "fine_px"),
    "stab_max_deg": ("stabilize", "max_deg"), "anchor_refresh": ("stabilize", "anchor_refresh_scans"),
    "verify_on": ("verify", "enabled"), "escalate_after": ("verify", "escalate_after"),
    "escalate_scale": ("verify", "escalate_scale"),
}


def load_params(path: str) -> ScanParams:
    """JSON, or YAML where a YAML reader is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        config = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML settings needs PyYAML; JSON works without it") from e
        config = yaml.safe_load(text)
    return ScanParams.from_config(config)


def dwell_scans(seconds: float, interval_s: float) -> int:
    """Scans needed to span a duration at a cadence."""
    return max(1, -int(-seconds // interval_s))
