"""Configuration files: flat TOML, typed by the defaults."""

from __future__ import annotations

import json
import os
import tomllib
from pathlib import Path

from ..operators.linking import Settings

#: Names and defaults of the settings that the operators use.
DEFAULTS = {
    "gmm_n_samples": 100,
    "gmm_bic_improvement": 10.0,
    "gmm_min_std": 10.0,
    "gmm_reg_covar": 1e-3,
    "gmm_lowp": 120.0,
    "arena_min_area_frac": 0.01,
    "arena_blur_sigma": 3.0,
    "bgdiff_type": "dark",
    "thr_method": "fixed",
    "thr_fixed": 15,
    "morph_open": 3,
    "morph_close": 5,
    "detect_max_candidates": 5,
    "expected_fly_area_min": 10,
    "expected_fly_area_max": 1500,
    "max_jump_px": 40.0,
    "miss_tolerance": 15,
    "use_kalman": False,
    "kalman_smoothing": False,
    "arena_diameter_mm": 75.0,
    "roi_downscale": 2,
    "n_tracking_workers": 4,
    "bg_deghost_percentile": 98,
    "bg_deghost_margin": 15,
    "bg_model_percentile": 90,
    "bg_model_fill_stationary": False,
    "bg_model_fill_min_area": 15,
    "bg_model_fill_max_area": 4000,
    "bg_model_fill_exclude_center": 0.0,
    "bg_refine_stuck_cov": 0.8,
    "bg_refine_fly_radius": 13,
    "bg_refine_fly_max_area": 4000,
    "qc_edge_pinned_frac": 0.9,
    "qc_low_activity_mm_s": 0.05,
    "batch_concurrency": 4,
    "batch_core_budget": 0,
    "track_stride": 1,
    "detect_params_ref_downscale": 2,
    "bg_protect_radius_px": 25.0,
    "bg_fg_dilate_px": 7,
    "bg_asym_update": False,
    "bg_step_up": 1.0,
    "bg_step_down": 0.02,
    "crop_size": 96,
    "crop_pad_mode": "background",
    "output_format": "parquet",
    "output_dir": "",
    "pose_every_n": 1,
    "pose_label_context": 10,
    "pose_conf_min": 0.2,
    "pose_headtail_flip_deg": 120.0,
    "pose_wing_extend_frac": 0.15,
    "port_edge_min": 4.0,
    "port_max_center_frac": 0.30,
    "port_radius_frac_min": 0.04,
    "port_radius_frac_max": 0.14,
    "qc_min_contrast": 10.0,
    "qc_montage_max": 25,
}
#: Settings of an earlier background model; a file that has any is rewritten without them.
RETIRED = ("bg_method", "bg_brightness_threshold", "bg_converge_eps", "bg_fg_thresh", "bg_inpaint_ghosts", "bg_ghost_area_min", "bg_ghost_area_max", "bg_min_frames", "bg_max_frames")


def dumps(values: dict) -> str:
    """TOML of a flat table; a JSON string or number is one of TOML too."""
    return "".join(f"{k} = {json.dumps(v, ensure_ascii=False)}\n" for k, v in values.items())


def save(path: str | Path, values: dict) -> None:
    """Replaces the file at once."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    part.write_text(dumps(values), encoding="utf-8")
    os.replace(part, path)


def load(path: str | Path) -> dict:
    """The defaults with the file's values; other keys count for nothing. A missing file is made."""
    path, values = Path(path), dict(DEFAULTS)
    found = tomllib.loads(path.read_text(encoding="utf-8")) if path.exists() else {}
    for k, v in found.items():
        if k in values:
            values[k] = float(v) if isinstance(values[k], float) and isinstance(v, int) else v
    if not path.exists() or not found.keys().isdisjoint(RETIRED):
        save(path, values)
    return values


def link_settings(values: dict, centers: dict[str, tuple[float, float]]) -> Settings:
    return Settings(values["max_jump_px"], values["miss_tolerance"], values["use_kalman"], values["kalman_smoothing"], centers)


def flag_settings(values: dict) -> dict:
    """Arguments of qc.flags."""
    return {"crop_size": values["crop_size"], "area_min": values["expected_fly_area_min"], "area_max": values["expected_fly_area_max"], "max_jump": values["max_jump_px"], "min_contrast": values["qc_min_contrast"]}


def concurrency(values: dict, n_videos: int, cores: int | None = None) -> int:
    """Videos at once: as set, else as many as the cores have room for workers."""
    room = (values["batch_core_budget"] or cores or os.cpu_count() or 1) // max(1, values["n_tracking_workers"])
    return max(1, min(values["batch_concurrency"] or room, n_videos))


def chosen_rois(have: list[str], asked: list[str]) -> list[str]:
    """Names from repeated or comma-separated options, once each, in their order; an unknown one is an error."""
    names = list(dict.fromkeys(n.strip() for part in asked for n in part.split(",") if n.strip()))
    if unknown := [n for n in names if n not in have]:
        raise ValueError(f"unknown arenas {', '.join(unknown)}; there are {', '.join(sorted(have))}")
    return names or list(have)
