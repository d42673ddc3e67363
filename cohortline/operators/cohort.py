"""Alignment of cumulative series on the day an entity reaches a threshold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortline.functions import column, reversed_level_rank
from cohortline.operators.series import valid_until


def align_since_threshold(
    series: DataFrame,
    entity: str,
    date: str,
    count: str,
    threshold: float,
    latest: object | None = None,
) -> DataFrame:
    """Number the rows of each entity from the first one at or above the threshold.

    ``series`` holds one row per entity and date. ``Day`` counts the rows that are kept,
    not calendar days: a correction below the threshold drops out and later rows move up.
    ``NumDays`` is the entity's last ``Day``. With ``latest`` (a value or a scalar
    column), only entities that reach the threshold on that date are kept.

    All windows share the partitioning by entity: one shuffle serves them all.
    """
    by_entity = W.partitionBy(entity)
    if latest is not None:
        at_latest = latest if isinstance(latest, Column) else F.lit(latest)
        newest = F.max(F.when(column(date) == at_latest, column(count))).over(by_entity)
        series = series.withColumn("_newest", newest).filter(F.col("_newest") >= threshold)
        series = series.drop("_newest")
    kept = series.filter(column(count) >= threshold)
    day = F.row_number().over(by_entity.orderBy(date, count))
    return kept.withColumn("Day", day).withColumn("NumDays", F.max("Day").over(by_entity))


def align_runs(
    cumulative: DataFrame,
    entity: str,
    date: str,
    count: str,
    threshold: float,
    last_date: Column,
) -> DataFrame:
    """Alignment of a series with gaps, each row standing for its run of calendar days.

    Numbers the days as :func:`align_since_threshold` does after
    :func:`~cohortline.operators.series.carry_forward`, without writing them out: a row
    covers the days ``Day`` to ``LastDay``. Long gaps cost nothing, and all windows use one
    sort by entity and date.
    """
    by_entity = W.partitionBy(entity)
    so_far = by_entity.orderBy(date).rowsBetween(W.unboundedPreceding, W.currentRow)
    length = F.date_diff(valid_until(entity, date, last_date), column(date)) + 1
    kept = (
        cumulative.withColumn("_length", length)
        .filter((F.col("_length") > 0) & (column(count) >= threshold))
        .withColumn("LastDay", F.sum("_length").over(so_far).cast("int"))
    )
    return (
        kept.withColumn("Day", F.col("LastDay") - F.col("_length") + 1)
        .withColumn("NumDays", F.max("LastDay").over(by_entity))
        .drop("_length")
    )


def label_last_day(aligned: DataFrame, entity: str, label: str = "label") -> DataFrame:
    """Put the entity's name on its last row and null on the others."""
    return aligned.withColumn(label, F.when(F.col("Day") == F.col("NumDays"), column(entity)))


def label_maximum(df: DataFrame, entity: str, value: str, label: str = "label") -> DataFrame:
    """Put the entity's name on every row that holds its largest value; ties all get it."""
    largest = F.max(value).over(W.partitionBy(entity))
    return df.withColumn(label, F.when(column(value) == largest, column(entity)))


def comparison_subset(
    aligned: DataFrame, entity: str, focal: str, peers: Sequence[str]
) -> DataFrame:
    """The focal entity and its peers, labelled on the last day, in reversed listing order."""
    names = [focal, *peers]
    subset = aligned.filter(column(entity).isin(*names))
    return label_last_day(subset, entity).withColumn(
        f"{entity}_ord", reversed_level_rank(entity, names)
    )


def fan_out_sets(
    df: DataFrame, entity: str, sets: Mapping[str, Sequence[str]], to: str
) -> DataFrame:
    """One row per comparison set that lists the entity; entities in no set drop out."""
    listed = {name for names in sets.values() for name in names}
    member_of = F.array_compact(
        F.array(*[F.when(column(entity).isin(*names), F.lit(key)) for key, names in sets.items()])
    )
    return df.filter(column(entity).isin(*sorted(listed))).withColumn(to, F.explode(member_of))


def comparison_sets(
    aligned: DataFrame, entity: str, focal: str, sets: Mapping[str, Sequence[str]], to: str
) -> DataFrame:
    """:func:`comparison_subset` for several sets of peers in one pass over the series."""
    listed = {key: [focal, *peers] for key, peers in sets.items()}
    rank = F.coalesce(
        *[F.when(column(to) == key, reversed_level_rank(entity, n)) for key, n in listed.items()]
    )
    fanned = fan_out_sets(label_last_day(aligned, entity), entity, listed, to)
    return fanned.withColumn(f"{entity}_ord", rank)
