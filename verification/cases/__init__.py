"""Registered queries: each has a Spark callable and, where SQL can state it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from verification.oracle_views import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
MODULES = ["sources", "scalars", "joins", "aggregates", "sampling", "features", "retrieval", "models", "metrics", "report", "audit"]


def case(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return register


def load_all() -> None:
    for module in MODULES:
        import_module(f"verification.cases.{module}")
