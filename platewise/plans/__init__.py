"""Registered queries over the given tables, each with its checking SQL."""

from __future__ import annotations

import importlib

_MODULES = ("tables", "scalars", "aggregates", "safety", "health", "recommend", "panels", "streams")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")


def all_queries() -> dict:
    _load()
    from .registry import QUERIES

    return dict(QUERIES)


def all_sql() -> dict:
    _load()
    from .registry import SQL

    return dict(SQL)
