"""Settings: defaults merged with a YAML overlay, checked strictly."""

from __future__ import annotations

from typing import Any

DEFAULTS: dict[str, Any] = {
    "chunking": {"size": 1000},
    "names": {"min_chars": 4},
    "works": {"fuzzy_set": 85, "fuzzy_ratio": 60, "publishable_after_years": 95},
    "vectors": {"dimension": 1024},
    "serving": {"profile": "full", "max_limit": 500},
}
RANGES = {"chunking.size": (1, 1_000_000), "names.min_chars": (1, 50), "works.fuzzy_set": (0, 100), "works.fuzzy_ratio": (0, 100), "works.publishable_after_years": (0, 500), "vectors.dimension": (1, 65_536), "serving.max_limit": (1, 100_000)}


def merged(base: dict, overlay: dict, path: str = "") -> dict:
    """Deep merge; unknown keys, wrong types and values out of range raise."""
    out = dict(base)
    for key, value in overlay.items():
        at = f"{path}.{key}" if path else key
        if key not in base:
            raise ValueError(f"unknown setting {at}")
        if isinstance(base[key], dict):
            if not isinstance(value, dict):
                raise ValueError(f"{at} must be a mapping")
            out[key] = merged(base[key], value, at)
            continue
        if type(value) is not type(base[key]):
            raise ValueError(f"{at} must be of type {type(base[key]).__name__}")
        low, high = RANGES.get(at, (None, None))
        if low is not None and not low <= value <= high:
            raise ValueError(f"{at} must be from {low} to {high}")
        out[key] = value
    return out


def load(text: str) -> dict:
    import yaml

    return merged(DEFAULTS, yaml.safe_load(text) or {})
