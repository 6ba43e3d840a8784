"""Configuration: nested, strict settings with presets, merged from names, files, dictionaries and dotted strings."""

from __future__ import annotations

import copy
from pathlib import Path
from typing import Any

import yaml

_SOLVER = {"loss": {"name": "cauchy", "params": [0.25]}, "max_num_iterations": 100, "function_tolerance": 0.0, "gradient_tolerance": 0.0, "parameter_tolerance": 1e-5, "use_nonmonotonic_steps": False}
_SAMPLING = {"mode": "BICUBIC", "l2_normalize": True, "ncc_normalize": False, "nodes": [[0.0, 0.0]], "check_bounds": False}

# The effective defaults.
DEFAULT: dict[str, Any] = {
    "dense_features": {"model": {"name": "image"}, "patch_size": 16, "max_edge": 1600, "sparse": True, "dtype": "half", "pyr_scales": [1.0], "use_cache": False, "load_cache_on_init": False, "l2_normalize": True},
    "interpolation": _SAMPLING,
    "keypoint_adjustment": {"apply": True, "strategy": "featuremetric", "level_indices": None, "max_kps_per_problem": 50, "optimizer": {**_SOLVER, "bound": 4.0, "root_regularize_weight": -1.0, "weight_by_sim": True, "root_edges_only": False}, "split_in_subproblems": True},
    "bundle_adjustment": {
        "apply": True, "strategy": "feature_reference", "level_indices": None, "max_tracks_per_problem": 10,
        "optimizer": {**_SOLVER, "parameter_tolerance": 0.0, "refine_focal_length": True, "refine_principal_point": False, "refine_extra_params": True, "refine_extrinsics": True, "min_track_length": -1},
        "references": {"loss": {"name": "cauchy", "params": [0.25]}, "iters": 100, "keep_observations": False, "compute_offsets3D": False},
        "costmaps": {"loss": {"name": "trivial", "params": []}, "as_gradientfield": True, "compute_cross_derivative": False, "apply_sqrt": False, "upsampling_factor": 1},
    },
    "localization": {
        "target_reference": "nearest", "unique_inliers": "min_error", "max_tracks_per_problem": 50,
        "PnP": {"max_error": 12.0, "seed": 0, "max_trials": 200},
        "QKA": {"apply": True, "feature_inlier_thresh": -1.0, "stack_correspondences": False, "optimizer": {**_SOLVER, "loss": {"name": "trivial", "params": []}, "bound": 4.0}},
        "QBA": {"apply": True, "optimizer": {**_SOLVER, "parameter_tolerance": 0.0, "refine_focal_length": False, "refine_principal_point": False, "refine_extra_params": False}},
    },
}

# Presets, as differences from the defaults.
PRESETS: dict[str, dict[str, Any]] = {
    "default": {},
    "norefine": {"keypoint_adjustment": {"apply": False}, "bundle_adjustment": {"apply": False}, "localization": {"QKA": {"apply": False}, "QBA": {"apply": False}}},
    "low_memory": {"dense_features": {"use_cache": True, "load_cache_on_init": False}, "keypoint_adjustment": {"strategy": "topological_reference", "optimizer": {"root_edges_only": True, "weight_by_sim": False}}, "bundle_adjustment": {"strategy": "costmaps"}},
    "photometric": {
        "dense_features": {"model": {"name": "image"}, "l2_normalize": False},
        "interpolation": {"l2_normalize": False, "ncc_normalize": True, "nodes": [[x, y] for y in (-1.5, -0.5, 0.5, 1.5) for x in (-1.5, -0.5, 0.5, 1.5)]},
        "keypoint_adjustment": {"apply": False}, "bundle_adjustment": {"strategy": "patch_warp"}, "localization": {"QKA": {"apply": False}},
    },
    "evaluation": {
        "dense_features": {"model": {"name": "s2dnet", "num_layers": 1}, "sparse": True, "max_edge": 1600, "patch_size": 16},
        "bundle_adjustment": {"optimizer": {"max_num_iterations": 10, "refine_focal_length": False, "refine_extra_params": False, "refine_extrinsics": False}},
        "localization": {"QBA": {"optimizer": {"refine_focal_length": False, "refine_extra_params": False}}},
    },
    "evaluation_two_layers": {
        "dense_features": {"model": {"name": "s2dnet", "num_layers": 2, "remove_pooling_layers": True}, "sparse": True, "max_edge": 1600, "patch_size": 12},
        "bundle_adjustment": {"optimizer": {"max_num_iterations": 10, "refine_focal_length": False, "refine_extra_params": False, "refine_extrinsics": False}},
        "localization": {"QBA": {"optimizer": {"refine_focal_length": False, "refine_extra_params": False}}},
    },
    "dsift": {"dense_features": {"model": {"name": "dsift"}}},
}


def merge(base: dict, change: dict, path: str = "") -> dict:
    """The base with the change's values; a key that the base lacks, or a group in place of a value, is an error. Free-form groups: a model's settings."""
    out = copy.deepcopy(base)
    for key, value in change.items():
        here = f"{path}.{key}".lstrip(".")
        if key not in out and not path.endswith("model"):
            raise KeyError(f"unknown setting {here!r}")
        known = out.get(key)
        if isinstance(known, dict) != isinstance(value, dict) and known is not None:
            raise TypeError(f"{here!r} is {'a group' if isinstance(known, dict) else 'no group'}")
        if known is not None and value is not None and not isinstance(known, dict) and not _alike(known, value):
            raise TypeError(f"{here!r} takes {type(known).__name__}, not {type(value).__name__}")
        out[key] = merge(known, value, here) if isinstance(known, dict) else copy.deepcopy(value)
    return out


def _alike(known: Any, value: Any) -> bool:
    if isinstance(known, bool) or isinstance(value, bool):
        return isinstance(known, bool) and isinstance(value, bool)
    if isinstance(known, (int, float)) and isinstance(value, (int, float)):
        return True
    return isinstance(value, type(known)) or isinstance(known, (list, tuple)) and isinstance(value, (list, tuple))


def dotted(items: list[str]) -> dict:
    """["a.b=1", ...] as a nested dictionary; values in YAML."""
    out: dict = {}
    for item in items:
        name, found, value = item.partition("=")
        if not found:
            raise ValueError(f"{item!r} is no name=value")
        at = out
        *groups, last = name.split(".")
        for group in groups:
            at = at.setdefault(group, {})
        at[last] = yaml.safe_load(value)
    return out


def load(*parts: str | Path | dict | list[str]) -> dict:
    """The defaults changed by each part in turn: a preset's name, a YAML file, a dictionary, or a list of dotted strings."""
    out = copy.deepcopy(DEFAULT)
    for part in parts:
        if isinstance(part, dict):
            change = part
        elif isinstance(part, list):
            change = dotted(part)
        elif str(part) in PRESETS:
            change = PRESETS[str(part)]
        else:
            change = yaml.safe_load(Path(part).read_text()) or {}
        out = merge(out, change)
    return out
