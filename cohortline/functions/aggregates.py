"""Aggregates whose treatment of missing values differs from SQL's."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortline.functions.text import column


def _all_present(c: Column) -> Column:
    return F.count(c) == F.count(F.lit(1))


def strict_sum(col: str | Column) -> Column:
    """Sum that is null as soon as one input of the group is null."""
    c = column(col)
    return F.when(_all_present(c), F.sum(c))


def strict_mean(col: str | Column) -> Column:
    """Unweighted mean that is null as soon as one input of the group is null.

    Sum and count are kept apart, so a decimal input is added exactly and the
    result does not depend on the order in which partitions arrive.
    """
    c = column(col)
    return F.when(_all_present(c), F.try_divide(F.sum(c).cast("double"), F.count(c)))


def sum_or_zero(col: str | Column) -> Column:
    """Sum of the present values; 0 for a group that has none."""
    return F.coalesce(F.sum(column(col)), F.lit(0))


def horizontal_sum(cols: Sequence[str | Column]) -> Column:
    """Sum across the columns of one row; null if any of them is null."""
    return reduce(add, [column(c) for c in cols])
