"""Operators around the newest date of a table.

The newest date is a scalar subquery: one value, computed once by a partial aggregate
and pushed into the scan, without a driver round trip, a join or an unpartitioned window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from cohortline.functions import column


def latest(df: DataFrame, date: str) -> Column:
    """Newest value of the column over the whole table."""
    return df.agg(F.max(column(date)).alias("latest")).scalar()


def latest_of_series(series: DataFrame, date: str, measure: str) -> Column:
    """Newest date of a series that is the result of an aggregate, without a second scan of its input.

    The measure takes part, so the subquery needs the same partial sums as the series itself and Spark
    runs their exchange once for both.
    """
    newest = F.max(F.struct(column(date).alias("date"), column(measure).alias("measure")))
    return series.agg(newest.alias("newest")).select(F.col("newest.date").alias("latest")).scalar()


def levels_of_series(series: DataFrame, label: str, measure: str) -> Column:
    """The labels of a series that is the result of an aggregate, sorted; computed as in :func:`latest_of_series`."""
    found = F.collect_set(F.struct(column(label).alias("label"), column(measure).isNull().alias("missing")))
    names = series.where(column(label).isNotNull()).agg(found.alias("found"))
    return names.select(F.array_sort(F.array_distinct(F.col("found.label")))).scalar()


def newest_day_starts(df: DataFrame, time: str) -> Column:
    """Midnight of the newest day of a time column, in the column's own type: a bound that the scan can use."""
    midnight = F.to_date(F.max(column(time))).cast(df.schema[time].dataType)
    return df.agg(midnight.alias("midnight")).scalar()


def keep_latest(df: DataFrame, date: str) -> DataFrame:
    """Rows of the newest date; of a time column, those of the newest day."""
    return df.filter(column(date) >= newest_day_starts(df, date) if _has_time(df, date) else column(date) == latest(df, date))


def drop_latest(df: DataFrame, date: str) -> DataFrame:
    """All rows but those of the newest date; of a time column, but those of the newest day."""
    return df.filter(column(date) < newest_day_starts(df, date) if _has_time(df, date) else column(date) != latest(df, date))


def _has_time(df: DataFrame, date: str) -> bool:
    return isinstance(df.schema[date].dataType, (TimestampType, TimestampNTZType))


def value_at_latest(
    series: DataFrame, date: str, value: str, by: str | None = None
) -> DataFrame:
    """Newest value of each entity (or of the whole series), with its date."""
    aggregates = [
        F.max(column(date)).alias(date),
        F.max_by(column(value), column(date)).alias(value),
    ]
    return series.groupBy(by).agg(*aggregates) if by else series.agg(*aggregates)


def newest_snapshot(
    series: DataFrame, ids: Sequence[str], date: str, value: str, snapshot: str | Column
) -> DataFrame:
    """One row per place and date out of overlapping snapshots: the value of the newest one that has the date.

    A later snapshot corrects earlier ones, also by a missing value. Of equally new values the largest is kept.
    """
    newest = F.max(F.struct(column(snapshot).alias("at"), column(value).alias("value")))
    found = series.groupBy(*[column(c) for c in ids], column(date)).agg(newest.alias("_newest"))
    return found.select(*[column(c) for c in ids], column(date), F.col("_newest.value").alias(value))


def rows_for_entity(wide: DataFrame, entity: str, name: str, date_column: str) -> DataFrame:
    """One entity's values in one date column of a wide table, a row per matching row."""
    return wide.filter(column(entity) == name).select(column(date_column).alias("value"))


def last_column(wide: DataFrame) -> str:
    """Name of the last column, which in a wide series is the newest date."""
    return wide.columns[-1]
