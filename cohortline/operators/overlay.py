"""Axis statistics and two measures on one axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions import clip_to_domain, column, log10_ieee


def axis_domain(
    aligned: DataFrame, count: str, extra_days: int | Column = 30, by: Sequence[str] = ()
) -> DataFrame:
    """The ends of both axes: last day, last break, decades of the counts; a row per chart told apart by ``by``."""
    largest = F.max(column(count)).cast("double")
    beyond = extra_days if isinstance(extra_days, Column) else F.lit(extra_days)
    return aligned.groupBy(*by).agg(
        F.max("NumDays").cast("bigint").alias("last_day"),
        (F.max("NumDays") + beyond).cast("bigint").alias("last_break"),
        largest.alias("largest"),
        F.ceil(F.log10(largest)).alias("top_decade"),
        F.pow(F.lit(10.0), F.ceil(F.log10(largest)) + 1).alias("upper_limit"),
    )


def clip_counts(df: DataFrame, count: str, aligned: DataFrame, low: float = 10) -> DataFrame:
    """Null the counts outside the axis ``[low, upper_limit]`` of the aligned series."""
    upper = axis_domain(aligned, count).select("upper_limit").scalar()
    return df.withColumn(count, clip_to_domain(count, F.lit(float(low)), upper))


def with_drawn(
    df: DataFrame, count: str, axes: DataFrame, by: Sequence[str] = (), low: float = 10, to: str = "drawn"
) -> DataFrame:
    """Add the count as it is drawn: null outside ``[low, upper_limit]`` of its chart's axes (a row per chart)."""
    if not by:
        upper = axes.select("upper_limit").scalar()
        return df.withColumn(to, clip_to_domain(count, F.lit(float(low)), upper))
    limits = axes.select(*by, F.col("upper_limit").alias("_upper"))
    clipped = clip_to_domain(count, F.lit(float(low)), F.col("_upper"))
    return df.join(limits, list(by), "left").withColumn(to, clipped).drop("_upper")


def two_scales(
    df: DataFrame,
    count: str,
    index: str,
    factor: float = 0.05,
    value_domain: tuple[float, float] = (1, 5),
    day_domain: tuple[float, float] = (0, 100),
) -> DataFrame:
    """Log of a count and a rescaled index side by side, both clipped to the drawn area.

    Rows without a count are dropped; a count of 0 has the logarithm -Infinity and is
    clipped like any value outside the area.
    """
    shown_day = clip_to_domain("Day", *[F.lit(v) for v in day_domain])
    return (
        df.filter(column(count).isNotNull())
        .withColumn("count_log10", log10_ieee(count))
        .withColumn("count_drawn", clip_to_domain("count_log10", *value_domain))
        .withColumn("index_drawn", clip_to_domain(column(index) * factor, *value_domain))
        .withColumn("day_drawn", shown_day)
    )
