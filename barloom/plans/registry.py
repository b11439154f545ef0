"""All registered queries of the event-study engine with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "touch_reaction"
MODULES = ("bar_queries", "feature_queries", "event_queries", "study_queries", "clock_queries", "stream_queries", "control_queries", "relation_queries", "setup_queries", "plan_queries", "grid_queries", "search_queries", "resampling_queries", "clustering_queries", "regime_queries", "source_queries")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with SQL for the same rows if there is some."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"barloom.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
