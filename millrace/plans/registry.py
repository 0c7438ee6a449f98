"""Name, Spark query and DuckDB SQL of every query outside the training-data subpackage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    run: Query
    sql: str | None


_all: dict[str, Registered] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def put(run: Query) -> Query:
        _all[run.__name__] = Registered(run, sql)
        return run

    return put


def _loaded() -> dict[str, Registered]:
    from . import analytics, estimates, frames, further, joins, relational, spans, statistics, stores, streams  # noqa: F401  register their queries

    return _all


def queries() -> dict[str, Query]:
    return {name: q.run for name, q in _loaded().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in _loaded().items() if q.sql}
