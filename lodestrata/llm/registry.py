"""All named queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("q_documented_code", "q_conversations", "q_tokens", "q_mixing", "q_prose", "q_handwritten", "q_chunking", "q_neighbours")


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"lodestrata.llm.{name}"), attribute)
    return found


def queries() -> dict[str, Callable]:
    return _collect("QUERIES")


def oracles() -> dict[str, str]:
    return _collect("ORACLES")
