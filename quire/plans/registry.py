"""Named queries, each with the SQL that it must agree with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Queries with no counterpart among the document operators: plain Spark features offered beside them.
EXTENSIONS: set[str] = set()


def query(sql: str | None = None, *, name: str | None = None, extension: bool = False) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        if extension:
            EXTENSIONS.add(key)
        return f

    return add
