"""Daily refresh of cohorts: a small state per entity instead of a full rerun.

A doubling table looks back 28 kept rows, so the newest 29 of an entity, their number and the newest
date that was seen are all that new dates need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortline.functions import column

#: Four weeks and the day they start from.
KEPT_ROWS = 29


def _row(date: str, count: str) -> Column:
    return F.struct(column(date).alias("date"), column(count).cast("double").alias("count"))


def cohort_state(
    series: DataFrame, entity: str, date: str, count: str, threshold: float, keep: int = KEPT_ROWS
) -> DataFrame:
    """``entity, last_date, last_count, NumDays, tail``: one row per entity of a cumulative series.

    ``tail`` holds the newest rows at or above the threshold, in order, ``NumDays`` their number over all
    dates. An entity that has not reached the threshold has an empty tail. ``series`` has one row
    per entity and date; all is done in its partitioning by entity.
    """
    by_entity = W.partitionBy(entity)
    kept = column(count) >= threshold
    day = F.count_if(kept).over(by_entity.orderBy(date).rowsBetween(W.unboundedPreceding, W.currentRow))
    marked = series.select(
        column(entity), _row(date, count).alias("_row"), kept.alias("_kept"), day.alias("_day"),
        F.count_if(kept).over(by_entity).alias("_days"),
    )
    shown = F.when(F.col("_kept") & (F.col("_day") > F.col("_days") - keep), F.col("_row"))
    newest = F.max("_row")
    return marked.groupBy(column(entity)).agg(
        newest["date"].alias("last_date"),
        newest["count"].alias("last_count"),
        F.max("_days").cast("int").alias("NumDays"),
        F.array_sort(F.collect_list(shown)).alias("tail"),
    )


def refreshed_state(
    state: DataFrame,
    changes: DataFrame,
    history: DataFrame,
    entity: str,
    date: str,
    count: str,
    threshold: float,
    keep: int = KEPT_ROWS,
) -> DataFrame:
    """The state after ``changes``, rows of entity, date and count that are new or corrected.

    Rows later than an entity's newest date are appended to its state. A change of an earlier or equal date
    is a correction: its entity, and no other, is computed again from ``history``, the whole series with
    all changes in it, of which only such entities' rows go through the windows. New entities start from nothing. Equal to
    :func:`cohort_state` of the history.
    """
    known = state.select(column(entity), F.col("last_date").alias("_last"))
    judged = changes.join(known, entity, "left").withColumn("_late", F.coalesce(column(date) <= F.col("_last"), F.lit(False)))
    late = judged.filter("_late").select(column(entity)).distinct()
    corrected = cohort_state(history.join(late, entity, "left_semi"), entity, date, count, threshold, keep)

    fresh = judged.join(late, entity, "left_anti")
    row = _row(date, count)
    added = fresh.groupBy(column(entity)).agg(
        F.max(row).alias("_newest"),
        F.array_sort(F.collect_list(F.when(column(count) >= threshold, row))).alias("_added"),
    )
    none = F.array().cast(state.schema["tail"].dataType)
    whole = F.concat(F.coalesce("tail", none), F.coalesce("_added", none))
    days = F.coalesce("NumDays", F.lit(0)) + F.size(F.coalesce("_added", none))
    appended = state.join(late, entity, "left_anti").join(added, entity, "full_outer").select(
        column(entity),
        F.coalesce(F.col("_newest.date"), "last_date").alias("last_date"),
        F.when(F.col("_newest").isNotNull(), F.col("_newest.count")).otherwise(F.col("last_count")).alias("last_count"),
        days.alias("NumDays"),
        F.slice(whole, F.greatest(F.size(whole) - keep + 1, F.lit(1)), keep).alias("tail"),
    )
    return appended.unionByName(corrected)


def appended_rows(state: DataFrame, changes: DataFrame, entity: str, date: str, count: str, threshold: float) -> DataFrame:
    """The curve rows (entity, date, count, Day) that new dates add to what was written before.

    Rows of corrected entities are not among them. A day's file of these rows, below those of the days
    before, is the aligned curve; ``NumDays`` stands in the state.
    """
    known = state.select(column(entity), F.col("last_date").alias("_last"), F.col("NumDays").alias("_days"))
    late = F.max(F.coalesce(column(date) <= F.col("_last"), F.lit(False))).over(W.partitionBy(entity))
    fresh = changes.join(known, entity, "left").withColumn("_late", late).filter(~F.col("_late") & (column(count) >= threshold))
    day = F.coalesce("_days", F.lit(0)) + F.row_number().over(W.partitionBy(entity).orderBy(date))
    return fresh.select(column(entity), column(date), column(count), day.alias("Day"))


def state_ends(state: DataFrame, entity: str, interval: int = 7, intervals: int = 4) -> DataFrame:
    """``entity, NumDays, end_0, end_1, ...`` as :func:`~cohortline.operators.doubling.interval_ends` gives them."""
    reached = state.filter(F.col("NumDays") > 0)
    ends = []
    for k in range(intervals + 1):
        at = F.size("tail") - interval * k
        ends.append(F.when(at >= 1, F.get("tail", at - 1)["count"]).alias(f"end_{k}"))
    return reached.select(column(entity), "NumDays", *ends)
