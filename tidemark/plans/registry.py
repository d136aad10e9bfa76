"""Registry of catalogue queries and their DuckDB oracle SQL.

Each catalogue module declares a query with ``@query(name, oracle_sql)``; the callable
takes ``(spark, sf_dir)`` and returns a lazy DataFrame. ``oracle_sql`` is the same result
written as ANSI SQL over the driver's tables (``None`` for operators that have no SQL
equivalent, e.g. model fits; these are checked by properties in ``tests/``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every catalogue module (each registers its queries on import)."""
    from tidemark.plans.catalog import (  # noqa: F401
        scans, relational, aggregates, series, scalars, features, splits, evaluation, models, closed_forms)
