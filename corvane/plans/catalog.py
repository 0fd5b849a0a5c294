"""Registry of the named queries of the core and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None, once: bool = False) -> Callable[[Query], Query]:
    """Decorator: file a query under ``name`` with its oracle SQL, if any.

    ``once`` is for queries that make each result row from one row and keep its
    identifier: they read repeated rows as they are, and equal results are dropped
    at the end, when filters and projections have left little to move.
    """

    def keep(fn: Query) -> Query:
        _QUERIES[name] = (lambda spark, sf_dir: fn(spark, sf_dir).distinct()) if once else fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return keep


def _load() -> None:
    """Import the modules that register queries."""
    import importlib

    for module in MODULES:
        importlib.import_module(module)


MODULES = ("corvane.plans.text_queries", "corvane.plans.ingest_queries", "corvane.plans.retrieval_queries", "corvane.plans.evaluation_queries", "corvane.plans.window_queries")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions of a small table to their final chunks through the whole retrieval plan."""
    from corvane.plans import retrieval_queries as plans
    from corvane.plans.text_queries import _items

    return plans.hybrid_flow(spark, sf_dir, _items(spark, sf_dir))
