"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

import importlib
from types import ModuleType

FAMILIES = ("retrieval", "ledgers", "values", "evidences", "graphs")


def load() -> ModuleType:
    """Import every family of queries and return the registry they filled."""
    for name in FAMILIES:
        importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.registry")
