"""Queries over the driver's tables, one per operator or operator family."""

from __future__ import annotations

import importlib

MODULES = [
    "state_queries", "quality_queries", "panel_queries", "contrast_queries", "trend_queries",
    "evidence_queries", "source_queries", "landing_queries", "stream_queries",
]


def all_queries() -> dict:
    found: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"{__name__}.{name}")
        for key, query in module.QUERIES.items():
            if key in found:
                raise ValueError(f"query registered twice: {key}")
            found[key] = query
    return found
