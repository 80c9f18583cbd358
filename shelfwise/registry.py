"""Every registered query of the library part, with its SQL twin where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwise.sources.catalog import Library, sql

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("scans", "filters", "joins", "aggregates", "windows", "scalars", "library", "search", "feed", "feeds", "duplicates", "sync", "jobs", "retention", "streams", "montage")

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, twin: str | None = None):
    """Register a function of a Library as query name; twin: SQL over the logical and the generic tables."""

    def register(function: Callable[[Library], DataFrame]):
        _QUERIES[name] = lambda spark, path: function(Library(spark, path))
        if twin:
            _SQL[name] = sql(twin)
        return function

    return register


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"shelfwise.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
