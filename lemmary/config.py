"""Settings: defaults, a local file over them, the environment over both."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from typing import Any

DEFAULTS: dict[str, Any] = {
    "match": {"examples_per_rule": 1000},
    "mutation": {"instances_per_file": 10, "augmentations": 5, "permutations": 10},
    "filter": {"head_coverage": 0.05, "std_confidence": 0.5, "pca_confidence": 0.9, "positive_examples": 10},
    "sampling": {"seed": 42, "annotated": 500},
    "answers": {"tries": 3, "pause": 1.0},
}
PREFIX = "LEMMARY_"


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """Nested values of ``over`` replace those of ``base``; neither is changed."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def load(path: str | None = None, environ: Mapping[str, str] | None = None) -> dict[str, Any]:
    """LEMMARY_FILTER__STD_CONFIDENCE=0.6 sets filter.std_confidence; values are JSON, or text if they are not."""
    out = merged(DEFAULTS, {})
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            out = merged(out, json.load(f))
    for name, value in (os.environ if environ is None else environ).items():
        if name.startswith(PREFIX):
            try:
                parsed = json.loads(value)
            except ValueError:
                parsed = value
            for part in reversed(name[len(PREFIX) :].lower().split("__")):
                parsed = {part: parsed}
            out = merged(out, parsed)
    return out


def get(settings: Mapping[str, Any], path: str, default: Any = None) -> Any:
    """A value by its dotted path."""
    for part in path.split("."):
        if not isinstance(settings, Mapping) or part not in settings:
            return default
        settings = settings[part]
    return settings
