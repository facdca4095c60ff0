"""Plans: chunk layout helpers and the query registry."""

from __future__ import annotations

import importlib

_MODULES = ("stats", "detect", "spectral", "forensic", "filter", "catalog", "timeline", "live")


def load_all():
    """Import every query module once and return (queries, oracles)."""
    from echolake.plans import registry

    for name in _MODULES:
        importlib.import_module(f"echolake.plans.{name}_queries")
    return registry.QUERIES, registry.ORACLES
