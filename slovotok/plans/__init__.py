"""Registered queries: a name, the DataFrame query, and its equivalent in SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slovotok.session import shipped

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query."""

    def put(f: Query) -> Query:
        QUERIES[name] = shipped(f)
        if sql:
            ORACLE[name] = sql
        return f

    return put
