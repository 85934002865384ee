"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.QUERIES: dict[str, Query] = {}
        self.SQL: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(q: Query) -> Query:
            self.QUERIES[q.__name__] = q
            if sql:
                self.SQL[q.__name__] = sql
            return q

        return add
