"""All queries of the library with their SQL, gathered from the modules that define them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["q_align", "q_sequence", "q_geometry", "q_evaluate", "q_qc", "q_events", "q_composite", "q_checks", "q_proposals", "q_motion", "q_identity", "q_sensor", "q_features", "q_poses", "q_session"]
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the DuckDB SQL for the same rows."""

    def add(f: Query) -> Query:
        if f.__name__ in _QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def also(name: str, f: Query) -> None:
    """Registers a query, with its SQL, under a further name."""
    _QUERIES[name] = f
    if f.__name__ in _SQL:
        _SQL[name] = _SQL[f.__name__]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tandem.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
