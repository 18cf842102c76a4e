"""Operators for training-data pipelines; nothing else in the library imports them."""

from __future__ import annotations

import importlib
from types import ModuleType


def load() -> ModuleType:
    """Import the queries and return the module with QUERIES and SQL."""
    return importlib.import_module(f"{__name__}.queries")
