"""All queries over the driver's tables: a function and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"query {name} is registered twice")
    _QUERIES[name] = query
    if sql is not None:
        _ORACLE[name] = sql


def _load() -> None:
    from trajecta.plans import depth_and_clouds, grids_and_names, motion, trajectories  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
