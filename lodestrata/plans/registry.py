"""All named queries of the core."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Modules with ``QUERIES`` (name to callable) and ``ORACLES`` (name to SQL).
MODULES = ("lexical", "rollups", "histories", "codebase", "findings", "vectors", "router", "changes", "lookups", "message_trees", "analysis")
FLAGSHIP = "lexical_bm25_topk"


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"lodestrata.plans.{name}"), attribute)
    return found


def queries() -> dict[str, Callable]:
    return _collect("QUERIES")


def oracles() -> dict[str, str]:
    return _collect("ORACLES")
