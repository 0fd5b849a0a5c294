"""Registry of the training-data queries and their oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

MODULES = (
    "broken_pairs",
    "near_duplicates",
    "contributor_cap",
    "boilerplate",
    "top_items",
    "splitting",
    "tokenizing",
    "mixing",
    "reading_level",
)


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return keep


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"corvane.llm.{module}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
