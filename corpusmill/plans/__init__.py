"""The registered queries over the driver's tables, by topic."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("search", "lexical", "parsing", "graph", "evaluation", "stores", "more")


def load() -> None:
    """Imports all modules of queries, which register themselves."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
