"""The catalogue of queries and, where SQL can say the same, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def catalogue() -> tuple[dict[str, Query], dict[str, str]]:
    from . import events, histories, indexes, library, lifecycle, pairs, registry_views, retrieval, routing, streams  # noqa: F401

    return QUERIES, ORACLE_SQL
