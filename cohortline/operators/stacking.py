"""Stacking of row sets and level totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions import column, locale_key, strict_sum


SPREAD = 32


def bind_rows(*frames: DataFrame, fill: bool = False) -> DataFrame:
    """Stack by column name, keeping duplicates; ``fill`` allows columns to be missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill), frames)


def overlay(layers: Mapping[str, DataFrame], layer: str = "layer") -> DataFrame:
    """Stack row sets that share axes, each tagged with its layer name."""
    return bind_rows(
        *[df.withColumn(layer, F.lit(name)) for name, df in layers.items()], fill=True
    )


def with_total_level(
    df: DataFrame, entity: str, keys: Sequence[str], measure: str, total_name: str
) -> DataFrame:
    """Rows per (keys, entity) plus one row per key for all entities together.

    The rows are first reduced to one per entity and key; only those are doubled for
    the second level, so the input is read once and the total is no hot group.
    """
    fine = df.groupBy(*keys, entity).agg(strict_sum(measure).alias(measure))
    both = F.explode(F.array(column(entity), F.lit(total_name)))
    doubled = fine.select(*keys, measure, both.alias(entity))
    return doubled.groupBy(*keys, entity).agg(strict_sum(measure).alias(measure))


def with_first_appearance(
    df: DataFrame, label: str, position: str | Column, to: str
) -> DataFrame:
    """Add the position at which the row's label first appears, the key that orders labels by it.

    One row per label is joined back, so the number of labels is not limited. The rows of a
    label are spread by their position over ``SPREAD`` join keys, for which the label's row is
    repeated: where the labels are not broadcast, a frequent label does not fill one task.
    """
    first = df.groupBy(column(label).alias("_label")).agg(F.min(column(position)).alias(to))
    first = first.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    part = F.pmod(F.xxhash64(column(position)), F.lit(SPREAD)) == F.col("_part")
    return df.join(first, column(label).eqNullSafe(F.col("_label")) & part, "left").drop("_label", "_part")


def with_locale_rank(df: DataFrame, label: str, to: str, locale: str = "UNICODE_CI_AI") -> DataFrame:
    """Add the 1-based place of the row's label among all labels in the order of a locale; null for no label.

    Labels that the collation holds equal share a place: ``Potosí`` and ``potosi`` come before ``Potosz``, though the
    code point of ``í`` is larger. For tables of named levels: their names come as one sorted array.
    """
    key = locale_key(label, locale)
    names = df.where(column(label).isNotNull()).select(key.alias("name")).distinct()
    ordered = names.agg(F.sort_array(F.collect_list("name")).alias("names")).scalar()
    return df.withColumn(to, F.array_position(ordered, key))
