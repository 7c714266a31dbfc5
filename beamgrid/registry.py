"""Named queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"{name} is registered twice")
    _QUERIES[name] = query
    if sql:
        _SQL[name] = sql


def _load() -> None:
    from beamgrid import plans

    for m in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"{plans.__name__}.{m.name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
