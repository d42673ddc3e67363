"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from cohortline.llm.common import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the statement that must give the same rows."""

    def add(query: Query) -> Query:
        @wraps(query)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return query(spark, sf_dir)

        QUERIES[query.__name__] = shipped
        if sql is not None:
            SQL[query.__name__] = sql
        return shipped

    return add
