"""Reference growth lines: what a series would look like if it doubled every so many days."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions import doubling_growth

# Names of the lines and the days each one needs to double.
COUNTRY_RATES = {
    "cada_dia": 1,
    "cada_dos_dias": 2,
    "cada_tres_dias": 3,
    "cada_semana": 7,
    "cada_mes": 30,
}
DEPARTMENT_RATES = {
    "cada_dia": 1,
    "cada_dos_dias": 2,
    "cada_tres_dias": 3,
    "cada_semana": 7,
    "cada_2_semanas": 14,
    "cada_mes": 30,
}


def growth_lines(
    aligned: DataFrame,
    entity: str,
    count: str,
    start: float,
    rates: Mapping[str, int] = COUNTRY_RATES,
    extra_days: int = 10,
    by: Sequence[str] = (),
) -> DataFrame:
    """One line per rate over days 0 .. max(NumDays) + ``extra_days``, in the layout of ``aligned``.

    Only the largest number of days is taken from the data. Days and rates are generated from
    that one row; a line never falls, so its largest value is the one on its last day.
    ``by`` names columns that tell several charts apart, each with lines of its own length.
    """
    names = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(r).alias("rate")) for n, r in rates.items()]
    )
    last = F.col("last")
    days = (
        aligned.groupBy(*by)
        .agg((F.max("NumDays") + extra_days).alias("last"))
        .select(*by, last, F.explode(F.sequence(F.lit(0), last)).alias("elapsed"))
        .select(*by, last, "elapsed", F.explode(names).alias("line"))
    )
    value = doubling_growth(start, "rate", "elapsed")
    largest = doubling_growth(start, "rate", "last")
    lines = days.select(*by, "last", "elapsed", F.col("line.name").alias(entity), "line.rate")
    return lines.select(
        *by,
        entity,
        value.alias(count),
        (F.col("elapsed") + 1).alias("Day"),
        (last + 1).alias("NumDays"),
        F.when(value == largest, F.col(entity)).alias("label"),
    )
