"""Registered queries."""

from __future__ import annotations

import importlib

from wayframe.catalog.registry import REGISTRY, Query

_PARTS = ("labelling", "rl", "objects", "expressions", "dataset", "rasters", "audits", "storage", "streams")


def load() -> dict[str, Query]:
    """All registered queries, by name."""
    for part in _PARTS:
        importlib.import_module(f"wayframe.catalog.{part}")
    return REGISTRY
