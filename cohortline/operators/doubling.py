"""Weekly doubling times of aligned series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions import blank_if, column, doubling_days, fill_blank, paste, swap

# Headers and cell texts of the doubling-time table.
WEEK_HEADERS = [
    "Última Semana",
    "Penúltima Semana",
    "Antepenúltima Semana",
    "Trasantepenúltima Semana",
]
DAYS_TEXT = "días"
NO_CHANGE_TEXT = "Sin Cambio"
MISSING_TEXT = "NA"


def interval_ends(
    aligned: DataFrame,
    entity: str,
    count: str,
    interval: int = 7,
    intervals: int = 4,
) -> DataFrame:
    """Counts at 0, 1, 2, ... intervals before each entity's last row, as columns ``end_0`` ...

    One aggregate over the rows, already partitioned by entity; an end that lies before
    the first row is null. Rows that stand for a run of days have a ``LastDay``.
    """
    last_day = F.col("LastDay" if "LastDay" in aligned.columns else "Day")
    ends = []
    for k in range(intervals + 1):
        here = (F.col("NumDays") - interval * k).between(F.col("Day"), last_day)
        ends.append(F.max(F.when(here, column(count).cast("double"))).alias(f"end_{k}"))
    return aligned.groupBy(entity).agg(F.max("NumDays").alias("NumDays"), *ends)


def doubling_times(
    aligned: DataFrame,
    entity: str,
    count: str,
    interval: int = 7,
    headers: Sequence[str] = WEEK_HEADERS,
) -> DataFrame:
    """Doubling time in days per entity and interval, newest first, as text cells.

    A cell is a whole number, ``Sin Cambio`` when both ends are equal, or null when the
    series does not reach back that far. An entity with a single row has no change in
    any interval.
    """
    return times_of_ends(interval_ends(aligned, entity, count, interval, len(headers)), entity, interval, headers)


def times_of_ends(
    ends: DataFrame, entity: str, interval: int = 7, headers: Sequence[str] = WEEK_HEADERS
) -> DataFrame:
    """:func:`doubling_times` from the counts at the ends of the intervals."""
    cells = []
    for k, header in enumerate(headers):
        last, first = F.col(f"end_{k}"), F.col(f"end_{k + 1}")
        days = doubling_days(first, last, interval).cast("bigint").cast("string")
        cell = F.when((F.col("NumDays") == 1) | (last == first), F.lit(NO_CHANGE_TEXT))
        cells.append(cell.otherwise(days).alias(header))
    return ends.select(entity, *cells)


def doubling_table(
    aligned: DataFrame,
    entity: str,
    count: str,
    interval: int = 7,
    headers: Sequence[str] = WEEK_HEADERS,
    marker: str = "Semana",
) -> DataFrame:
    """The printed form of :func:`doubling_times`: ``7 días``, ``Sin Cambio`` or ``NA``."""
    return printed_table(doubling_times(aligned, entity, count, interval, headers), marker)


def printed_table(raw: DataFrame, marker: str = "Semana") -> DataFrame:
    """The printed form of doubling times: cells of the columns whose name holds the marker get their unit."""

    def printed(name: str):
        with_unit = paste(column(name), F.lit(DAYS_TEXT))
        present = fill_blank(blank_if(with_unit, f"{MISSING_TEXT} {DAYS_TEXT}"), MISSING_TEXT)
        return swap(present, f"{NO_CHANGE_TEXT} {DAYS_TEXT}", NO_CHANGE_TEXT).alias(name)

    return raw.select(*[printed(c) if marker in c else column(c) for c in raw.columns])


def with_focal_order(table: DataFrame, entity: str, focal: str, to: str | None = None) -> DataFrame:
    """Add the place of each row in the printed table: the focal entity is 1, the others follow by name.

    For tables of a few named entities: their names come as one sorted array.
    """
    others = F.filter(F.array_sort(F.collect_set(column(entity))), lambda name: name != F.lit(focal))
    names = table.agg(F.concat(F.array(F.lit(focal)), others).alias("names")).scalar()
    return table.withColumn(to or f"{entity}_ord", F.array_position(names, column(entity)))


def focal_first(table: DataFrame, entity: str, focal: str) -> DataFrame:
    """Sort with the focal entity on top and the others by name."""
    return table.orderBy(F.when(column(entity) == focal, 0).otherwise(1), column(entity))
