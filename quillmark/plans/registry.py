"""Every registered query with its SQL: name -> (function of spark and folder, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with the SQL of its result if SQL can express it."""

    def put(fn: Query) -> Query:
        assert name not in _ALL, name
        _ALL[name] = (fn, sql)
        return fn

    return put


def _load() -> None:
    from . import catalog  # noqa: F401  registers on import


def queries() -> dict[str, Query]:
    _load()
    return {name: fn for name, (fn, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
