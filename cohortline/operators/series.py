"""Preparation of cumulative daily series.

Each function adds rows up per (entity, date) before anything is partitioned by
entity alone, so one entity never brings more rows to a task than it has dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortline.functions import column, strict_sum


def total_by_date(df: DataFrame, entity: str, date: str, measure: str) -> DataFrame:
    """One row per entity and date with the strict sum of the measure."""
    return df.groupBy(column(entity), column(date)).agg(
        strict_sum(measure).alias(measure)
    )


def count_by_date(
    df: DataFrame, entity: str, date: Column, date_to: str, count_to: str, wanted: Column | None = None
) -> DataFrame:
    """Number of rows per entity and date; with a condition, of those that meet it, 0 where none does."""
    counted = F.lit(1) if wanted is None else F.when(wanted, 1)
    return df.groupBy(column(entity), date.alias(date_to)).agg(F.count(counted).alias(count_to))


def running_total(daily: DataFrame, entity: str | list[str], date: str, measure: str) -> DataFrame:
    """Replace the measure by its running sum within the entity."""
    order = W.partitionBy(entity).orderBy(date).rowsBetween(W.unboundedPreceding, W.currentRow)
    return daily.withColumn(measure, F.sum(measure).over(order))


def valid_until(entity: str | list[str], date: str, last_date: Column) -> Column:
    """Last day on which a row is its entity's newest one: the day before the next row's."""
    next_date = F.lead(date).over(W.partitionBy(entity).orderBy(date))
    return F.coalesce(F.date_sub(next_date, 1), last_date)


def carry_forward(
    cumulative: DataFrame, entity: str | list[str], date: str, last_date: Column, months: int = 0
) -> DataFrame:
    """Repeat each row on the calendar days up to the entity's next row, or to ``last_date``.

    With ``months`` the steps are that many months instead of one day.

    Every row expands by itself, so no calendar table is joined and nothing is shuffled
    beyond the partitioning by entity that the next row needs anyway.
    """
    step = F.make_interval(months=F.lit(months)) if months else F.make_interval(days=F.lit(1))
    until = valid_until(entity, date, last_date)
    others = [c for c in cumulative.columns if c != date]
    bounded = cumulative.withColumn("_until", until).filter(F.col("_until") >= F.col(date))
    days = F.explode(F.sequence(F.col(date), F.col("_until"), step))
    return bounded.select(*others, days.alias(date)).select(*cumulative.columns)
