"""Registration of queries with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .mapping import Domain, show

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register `fn(domain)`; `check` is the SQL that must give the same rows."""
    def add(fn: Callable[[Domain], DataFrame]):
        QUERIES[name] = lambda spark, base: show(fn(Domain(spark, base)))
        if check is not None:
            SQL[name] = check
        return fn
    return add
