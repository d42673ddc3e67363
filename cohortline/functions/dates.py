"""Date parsing and formatting. Text that is not a date gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortline.functions.text import column


def parse_mdy(col: str | Column) -> Column:
    """``1/22/20`` to a date; two-digit years from 69 on belong to the last century."""
    parsed = F.try_to_date(column(col), "M/d/yy")
    return F.when(F.year(parsed) > 2068, F.add_months(parsed, -1200)).otherwise(parsed)


def parse_iso(col: str | Column) -> Column:
    """``2020-01-22`` to a date."""
    return F.try_to_date(column(col), "yyyy-MM-dd")


def parse_yyyymmdd(col: str | Column) -> Column:
    """Number ``20200122`` to a date."""
    return F.try_to_date(column(col).cast("bigint").cast("string"), "yyyyMMdd")


def dmy(col: str | Column, long_year: bool = False) -> Column:
    """Date as ``22/01/20``, or ``22/01/2020`` with ``long_year``."""
    return F.date_format(column(col), "dd/MM/yyyy" if long_year else "dd/MM/yy")


def day_before(col: str | Column) -> Column:
    return F.date_sub(column(col), 1)
