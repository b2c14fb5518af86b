"""Small tools of the query modules: registering a query with its SQL, and literal tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """Queries and oracle SQL of a module."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            key = name or f.__name__
            self.queries[key] = f
            if sql is not None:
                self.oracles[key] = sql
            return f

        return put


def literal(v: object) -> str:
    """A value as SQL that Spark and DuckDB read alike."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (int, float)):
        return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)
    return "'" + str(v).replace("'", "''") + "'"


def values_sql(columns: str, rows: list[tuple]) -> str:
    """SELECT over a VALUES list with named columns."""
    body = ", ".join(f"({', '.join(map(literal, r))})" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({columns}))"


def values(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    return spark.sql(f"SELECT * FROM {values_sql(columns, rows)}")
