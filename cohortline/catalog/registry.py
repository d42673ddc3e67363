"""Registry of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from cohortline.catalog.scope import building

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
OPERATORS: dict[str, tuple[str, ...]] = {}


def register(operators: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name.

    ``operators`` lists the survey's operator ids the query exercises; ``sql`` is the
    statement that must give the same rows.
    """

    def add(fn: Query) -> Query:
        @wraps(fn)
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            with building():
                return fn(spark, sf_dir)

        QUERIES[fn.__name__] = query
        OPERATORS[fn.__name__] = tuple(operators.split())
        if sql is not None:
            SQL[fn.__name__] = sql
        return query

    return add
