"""Benchmarks: region means, population weights, shares and ratios to a base entity.

Every group is reduced by a partial aggregate before it is shuffled, and totals are
joined back as one row per group, so a group that holds most of the rows costs no more
than any other. No join carries a broadcast hint: Spark picks the strategy from the
measured size of the smaller side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions import column, half_even, ratio, strict_mean, strict_sum, sum_or_zero


def members(
    dimension: DataFrame, key: str, condition: Column, exclude: Sequence[object] = ()
) -> DataFrame:
    """Distinct keys of the dimension rows that meet the condition, less the excluded ones."""
    codes = dimension.filter(condition).select(column(key)).distinct()
    return codes.filter(~column(key).isin(*exclude)) if exclude else codes


def keep_members(df: DataFrame, codes: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in the code set (its first column)."""
    codes = codes.toDF(on)
    return df.join(codes, on, "left_semi")


def group_mean(
    df: DataFrame, by: str, value: str, entity: str, name: str, digits: int | None = None
) -> DataFrame:
    """Unweighted mean per group as the series of one named entity."""
    mean = _rounded(strict_mean(value), digits)
    return df.groupBy(by).agg(mean.alias(value)).withColumn(entity, F.lit(name))


def region_and_world_mean(
    df: DataFrame,
    codes: DataFrame,
    on: str,
    by: str,
    value: str,
    entity: str,
    names: tuple[str, str],
    digits: int | None = None,
) -> DataFrame:
    """Unweighted means of the rows in a code set and of all rows, as two named series.

    Rows in the code set count twice, once per series, ahead of one partial aggregate:
    the input is read once for both.
    """
    region, world = names
    flagged = df.join(codes.toDF(on).distinct().withColumn("_member", F.lit(True)), on, "left")
    series = F.explode(F.array_compact(F.array(F.when(F.col("_member"), F.lit(region)), F.lit(world))))
    mean = _rounded(strict_mean(value), digits)
    fanned = flagged.select(by, value, series.alias(entity))
    return fanned.groupBy(entity, by).agg(mean.alias(value))


def _rounded(value: Column, digits: int | None) -> Column:
    return value if digits is None else half_even(value, digits)


def weighted_by_population(df: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """Mean per group with weights ``weight / sum(weight)`` that are not renormalised.

    A row without a value keeps its share of the weight, so it pulls the mean down; a
    group with no usable row gives 0. The common divisor is taken out of the sum, which
    makes this one aggregate instead of a join with the group's own total.
    """
    product = column(weight).cast("double") * column(value).cast("double")
    mean = F.try_divide(F.sum(product), sum_or_zero(weight).cast("double"))
    return df.groupBy(by).agg(F.coalesce(mean, F.lit(0.0)).alias(value))


def with_group_total(df: DataFrame, by: str, measure: str, total: str) -> DataFrame:
    """Add the strict total of the group to each row; rows without a group form one too.

    Joining the total back as one row per group, instead of a window over the group,
    keeps a large group spread over its tasks. Null-safe equality adds no null filter to
    either side, so both sides are the same plan and Spark runs it once.
    """
    totals = df.groupBy(column(by).alias("_group")).agg(strict_sum(measure).alias(total))
    return df.join(totals, column(by).eqNullSafe(F.col("_group")), "left").drop("_group")


def share_of_total(df: DataFrame, by: str, measure: str, share: str) -> DataFrame:
    """Add each row's share of its group's total."""
    total = f"{share}_total"
    return with_group_total(df, by, measure, total).withColumn(share, ratio(measure, total))


def segment_rates(
    df: DataFrame, keys: Sequence[str], weight: str, percent: str, rate: str
) -> DataFrame:
    """Population and rate (0..1) of each segment from rows that hold a percentage."""
    hits = column(percent).cast("double") / 100 * column(weight).cast("double")
    return (
        df.groupBy(*keys)
        .agg(strict_sum(weight).alias(weight), strict_sum(hits).alias("_hits"))
        .withColumn(rate, ratio("_hits", weight))
        .drop("_hits")
    )


def weighted_rate(
    segments: DataFrame, by: Sequence[str], weight: str, rate: str, to: str, scale: float = 100.0
) -> DataFrame:
    """Mean of the segments' rates, weighted by their share of the group's population.

    Equal to summing share times rate, with the group total taken out of the sum.
    """
    population = column(weight).cast("double")
    mean = F.try_divide(strict_sum(population * column(rate)), strict_sum(population))
    return segments.groupBy(*by).agg((mean * scale).alias(to))


def ratio_to_base(
    panel: DataFrame, entity: str, period: str, value: str, base: str, to: str
) -> DataFrame:
    """Add each row's value divided by the base entity's value of the same period.

    The base is one row per period and is joined rather than spread into a column, so
    the number of entities is not limited. The base's own rows are dropped.
    """
    base_values = (
        panel.filter(column(entity) == base)
        .groupBy(column(period).alias("_period"))
        .agg(F.max(column(value)).alias("_base"))
    )
    others = panel.filter(column(entity) != base)
    same_period = column(period).eqNullSafe(F.col("_period"))
    return (
        others.join(base_values, same_period, "left")
        .withColumn(to, ratio(value, "_base"))
        .drop("_period", "_base")
    )
