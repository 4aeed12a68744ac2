"""Registered queries: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator that registers a query, with its SQL where SQL can express it."""

    def keep(query: Query) -> Query:
        if name in _FOUND:
            raise ValueError(f"{name} is registered twice")
        _FOUND[name] = (query, sql)
        return query

    return keep


def _load() -> None:
    from pricetide.plans import crawl_queries, profile_queries, reference_queries, result_queries  # noqa: F401  register on import


def queries() -> dict[str, Query]:
    _load()
    return {name: query for name, (query, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _FOUND.items() if sql is not None}
