"""Running totals and numbering of series that are too long for one task.

A window over an entity puts all its rows into one task. Here an entity is cut into ranges of its order, such
as the days of a series of seconds: sums of the ranges, one row for each, give what stands before
a range, and windows stay within a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortline.functions import column


def _with_offsets(df: DataFrame, entity: str, span: Column, total: Column) -> DataFrame:
    """Adds ``_span``, what its entity's earlier spans add up to (``_before``) and all of them (``_whole``)."""
    spanned = df.withColumn("_span", span)
    sums = spanned.groupBy(column(entity), "_span").agg(total.alias("_sum"))
    earlier = W.partitionBy(entity).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        column(entity).alias("_entity"),
        F.col("_span").alias("_at"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_sum").over(W.partitionBy(entity)).alias("_whole"),
    )
    same = column(entity).eqNullSafe(F.col("_entity")) & F.col("_span").eqNullSafe(F.col("_at"))
    return spanned.join(offsets, same).drop("_entity", "_at")


def running_total_by_span(daily: DataFrame, entity: str, date: str, measure: str, span: Column) -> DataFrame:
    """:func:`~cohortline.operators.series.running_total` where an entity may have any number of rows.

    ``span`` cuts the order into ranges: it must not fall where ``date`` rises, and should hold
    as many rows as a task can sort. An entity has as many rows in the window of offsets as it has spans.
    """
    within = W.partitionBy(entity, "_span").orderBy(date).rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = _with_offsets(daily, entity, span, F.coalesce(F.sum(column(measure)), F.lit(0)))
    total = F.col("_before") + F.sum(measure).over(within)
    return offsets.withColumn(measure, total).select(*daily.columns)


def align_by_span(
    series: DataFrame, entity: str, date: str, count: str, threshold: float, span: Column
) -> DataFrame:
    """:func:`~cohortline.operators.cohort.align_since_threshold` where an entity may have any number of rows.

    Numbers as there, with ``Day`` and ``NumDays`` as 64-bit integers; ``span`` as in :func:`running_total_by_span`.
    """
    kept = series.filter(column(count) >= threshold)
    offsets = _with_offsets(kept, entity, span, F.count(F.lit(1)))
    within = W.partitionBy(entity, "_span").orderBy(date, count)
    day = F.col("_before") + F.row_number().over(within)
    return offsets.withColumn("Day", day).withColumn("NumDays", F.col("_whole")).select(*series.columns, "Day", "NumDays")
