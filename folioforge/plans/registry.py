"""Queries by name, and the SQL that should give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

Query = Callable[[SparkSession, str], DataFrame]


def shipped(query: Query) -> Query:
    """The query, with the package made known to the session's workers first."""

    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(ship(spark), folder)

    return run


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def put(query: Query) -> Query:
            key = name or query.__name__
            if key in self.queries:
                raise ValueError(f"two queries are named {key}")
            self.queries[key] = shipped(query)
            if sql is not None:
                self.sql[key] = sql
            return query

        return put
