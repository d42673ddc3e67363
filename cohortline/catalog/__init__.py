"""Registered queries on the driver's tables, each next to its SQL counterpart."""

from __future__ import annotations

from cohortline.catalog import cohorts, mapping, panels, trackers  # noqa: F401
from cohortline.catalog.registry import OPERATORS, QUERIES, SQL, Query


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)


def operators_by_query() -> dict[str, tuple[str, ...]]:
    return dict(OPERATORS)
