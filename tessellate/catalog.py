"""Registry of the queries checked by the driver: name -> Spark callable
and name -> DuckDB oracle SQL (when an exact SQL form exists)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


from . import queries as _queries  # noqa: E402,F401  (fills the registry)
