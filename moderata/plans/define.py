"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries and their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(run: Query) -> Query:
            self.queries[name] = run
            if sql:
                self.sql[name] = sql
            return run

        return add


def text(column: str) -> Column:
    """The column as text, under its name."""
    return F.col(column).cast("string").alias(column)
