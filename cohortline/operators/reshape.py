"""Wide/long reshaping and flattening of nested records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions import column

#: Columns that a reshape may make of levels it finds.
MOST_LEVELS = 10_000


def melt(
    df: DataFrame,
    ids: Sequence[str],
    names_to: str = "variable",
    values_to: str = "value",
    measures: Sequence[str] | None = None,
) -> DataFrame:
    """Wide to long; null cells are kept.

    ``measures`` defaults to every column that is not an id. A filter on ``names_to``
    does not travel below the reshape, so pass only the columns that are wanted.
    """
    if measures is None:
        measures = [c for c in df.columns if c not in set(ids)]
    return df.unpivot(
        [column(c) for c in ids], [column(c) for c in measures], names_to, values_to
    )


def melt_positions(
    df: DataFrame, ids: Sequence[str], measures: Sequence[str], position_to: str, values_to: str
) -> DataFrame:
    """Wide to long with the position of the column instead of its name.

    For tables with hundreds of columns of one type: one array per row and a number per
    cell, which is cheaper to make and to group by than a copy of the row and a text.
    :func:`name_at` gives the names back once the rows are added up.
    """
    kept = [column(c) for c in ids]
    packed = df.select(*kept, F.array(*[column(c) for c in measures]).alias("_cells"))
    # the array is never null or empty: the outer form keeps the optimizer from deriving a
    # filter on it, whose variants would multiply with every renamed column
    cells = F.posexplode_outer("_cells")
    return packed.select(*kept, cells.alias(position_to, values_to))


def name_at(position: str | Column, names: Sequence[str]) -> Column:
    """Name at a position counted from 0."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), column(position) + 1)


def found_levels(df: DataFrame, key: str, most: int = MOST_LEVELS) -> list:
    """The levels that occur, in ascending order; more than ``most`` are an error, as each becomes a column.

    Reads one column of the table. Missing keys are no level.
    """
    present = df.select(column(key).alias("level")).where("level IS NOT NULL").distinct()
    levels = [r["level"] for r in present.limit(most + 1).collect()]
    if len(levels) > most:
        raise ValueError(f"{key} has more than {most} levels: use level_map")
    return sorted(levels)


def spread(
    df: DataFrame, ids: Sequence[str], key: str, levels: Sequence[str] | None, value: str
) -> DataFrame:
    """Long to wide with one column per level; a missing cell is null.

    ``levels`` are all levels there can be, or a choice of them; None stands for those that occur, for
    which ``df`` is read once more (:func:`found_levels` of its input is cheaper). Of several values in one cell the largest is kept,
    whatever their order.
    """
    if levels is None:
        levels = found_levels(df, key)
    return df.groupBy(*ids).pivot(key, list(levels)).agg(F.max(column(value)))


def level_map(df: DataFrame, ids: Sequence[str], key: str, value: str, to: str) -> DataFrame:
    """Long to one row per id with a map from each of its levels to the value.

    No level has to be known or is left out; what a row does not have is not in its map. The largest of
    several values of one cell is kept. Missing keys are no level; a map is as long as its id has levels.
    """
    cells = df.where(column(key).isNotNull()).groupBy(*ids, key).agg(F.max(column(value)).alias("_value"))
    entry = F.struct(column(key).alias("key"), F.col("_value").alias("value"))
    return cells.groupBy(*ids).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(to))


def explode_records(
    df: DataFrame, records: str, date_field: str, values_field: str, key_to: str, value_to: str
) -> DataFrame:
    """Array of ``{date, map}`` records to one row per record and map entry."""
    one = df.select(F.posexplode(column(records)).alias("record", "r"))
    return one.select(
        "record",
        F.col(f"r.{date_field}").alias(date_field),
        F.explode(F.col(f"r.{values_field}")).alias(key_to, value_to),
    )
