"""Case and death curves of countries and departments with their doubling-time tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortline.functions import (
    column,
    day_before,
    dmy,
    parse_iso,
    parse_mdy,
    paste,
    promote,
    recode,
    thousands,
)
from cohortline.operators.cohort import (
    align_since_threshold,
    comparison_sets,
    fan_out_sets,
    label_last_day,
)
from cohortline.operators.doubling import doubling_table, with_focal_order
from cohortline.operators.growth import COUNTRY_RATES, DEPARTMENT_RATES, growth_lines
from cohortline.operators.latest import (
    last_column,
    latest_of_series,
    levels_of_series,
    newest_snapshot,
    rows_for_entity,
)
from cohortline.operators.overlay import axis_domain, with_drawn
from cohortline.operators.reshape import explode_records, melt_positions, name_at
from cohortline.operators.series import total_by_date
from cohortline.operators.stacking import bind_rows

# Names, threshold and comparison sets of the public dashboard.
THRESHOLD = 10
LOWEST_DRAWN = 10
DAYS_BEYOND = {"referencia": 30, "sudamerica": 10}
FOCAL = "Bolivia"
PLACE_COLUMNS = ["Province/State", "Country/Region", "Lat", "Long"]
COUNTRY_NAMES = {
    "Korea, South": "Corea del Sur",
    "US": "EEUU",
    "Italy": "Italia",
    "Spain": "España",
    "Singapore": "Singapur",
    "Brazil": "Brasil",
}
PROMOTED_PROVINCES = ["Hong Kong"]
REFERENCE_COUNTRIES = ["Corea del Sur", "Italia", "España", "EEUU", "Iran", "Singapur"]
SOUTH_AMERICA = [
    "Argentina",
    "Brasil",
    "Chile",
    "Colombia",
    "Paraguay",
    "Peru",
    "Uruguay",
    "Venezuela",
    "Ecuador",
]
DEPARTMENTS = [
    "La Paz",
    "Cochabamba",
    "Santa Cruz",
    "Oruro",
    "Potosí",
    "Tarija",
    "Chuquisaca",
    "Beni",
    "Pando",
]


def country_curves(
    wide: DataFrame,
    threshold: float = THRESHOLD,
    names: Mapping[str, str] = COUNTRY_NAMES,
    promoted: Sequence[str] = PROMOTED_PROVINCES,
    latest: str | None = None,
    keep_date: bool = False,
) -> DataFrame:
    """Aligned curves (Country, Count, Day, NumDays) from a wide cumulative series.

    Provinces are added up per country and date after going long, which needs the same
    sums as adding up each date column but not a plan with hundreds of aggregates.
    ``latest`` names the date column on which a country must reach the threshold; it
    defaults to the last one, and deaths are usually given the one of the cases.
    """
    latest = latest or last_column(wide)
    country = promote("Province/State", recode("Country/Region", names), promoted)
    dates = [c for c in wide.columns if c not in PLACE_COLUMNS]
    place = wide.withColumn("Country", country)
    long = melt_positions(place, ["Country"], dates, "position", "Count")
    totals = total_by_date(long, "Country", "position", "Count").select(
        "Country", parse_mdy(name_at("position", dates)).alias("Date"), "Count"
    )
    curves = align_since_threshold(
        totals, "Country", "Date", "Count", threshold, parse_mdy(F.lit(latest))
    )
    return curves if keep_date else curves.drop("Date")


def snapshot_curves(
    series: DataFrame,
    threshold: float = THRESHOLD,
    names: Mapping[str, str] = COUNTRY_NAMES,
    promoted: Sequence[str] = PROMOTED_PROVINCES,
    latest: Column | None = None,
) -> DataFrame:
    """:func:`country_curves` with dates, from the long form of overlapping snapshots (``read_series``).

    The newest snapshot that has a date gives its values; places are then added up per country. The
    newest date of all, or ``latest``, is the one on which a country must reach the threshold.
    """
    dated = series.withColumns({"Date": parse_mdy("Date"), "Snapshot": parse_mdy("Snapshot")})
    places = newest_snapshot(dated, ["Province/State", "Country/Region"], "Date", "Count", "Snapshot")
    country = promote("Province/State", recode("Country/Region", names), promoted)
    totals = total_by_date(places.withColumn("Country", country), "Country", "Date", "Count")
    at = latest_of_series(totals, "Date", "Count") if latest is None else latest
    return align_since_threshold(totals, "Country", "Date", "Count", threshold, at)


def long_series(wide: DataFrame) -> DataFrame:
    """A wide series as rows (Province/State, Country/Region, Date, Count)."""
    dates = [c for c in wide.columns if c not in PLACE_COLUMNS]
    long = melt_positions(wide, PLACE_COLUMNS[:2], dates, "position", "Count")
    return long.select(
        *[column(c) for c in PLACE_COLUMNS[:2]], parse_mdy(name_at("position", dates)).alias("Date"), "Count"
    )


def stored_series(measures: Mapping[str, DataFrame], path: str, measure: str = "Medida") -> dict[str, DataFrame]:
    """Wide series of several measures in long form, written once in one job, and read back.

    Every table of a tracker can then be made without another scan of the inputs: a reader of one measure
    and place skips the files and row groups of others.
    """
    tagged = [long_series(wide).withColumn(measure, F.lit(name)) for name, wide in measures.items()]
    bind_rows(*tagged).write.mode("overwrite").partitionBy(measure).parquet(path)
    spark = tagged[0].sparkSession
    kind = StructType([*tagged[0].drop(measure).schema.fields, StructField(measure, StringType())])
    stored = spark.read.schema(kind).parquet(path)
    return {name: stored.filter(column(measure) == name).drop(measure) for name in measures}


def series_curves(
    long: DataFrame,
    latest: Column,
    threshold: float = THRESHOLD,
    names: Mapping[str, str] = COUNTRY_NAMES,
    promoted: Sequence[str] = PROMOTED_PROVINCES,
) -> DataFrame:
    """:func:`country_curves` with dates, from a long series with one value per place and date."""
    country = promote("Province/State", recode("Country/Region", names), promoted)
    totals = total_by_date(long.withColumn("Country", country), "Country", "Date", "Count")
    return align_since_threshold(totals, "Country", "Date", "Count", threshold, latest)


def update_label(latest: str | Column, prefix: str = "Última fecha de actualización: ") -> Column:
    """Header text with the date as ``dd/mm/yyyy``."""
    day = latest if isinstance(latest, Column) else parse_iso(F.lit(latest))
    return paste(F.lit(prefix), dmy(day, long_year=True))


def country_total(wide: DataFrame, country: str = FOCAL, latest: str | None = None) -> DataFrame:
    """A country's newest value, plain and with separators; one row per matching place."""
    value = rows_for_entity(wide, "Country/Region", country, latest or last_column(wide))
    return value.withColumn("shown", thousands("value"))


def country_tracker(
    confirmed: DataFrame,
    deaths: DataFrame,
    focal: str = FOCAL,
    comparisons: Mapping[str, Sequence[str]] | None = None,
    threshold: float = THRESHOLD,
    store: str | None = None,
) -> dict[str, DataFrame]:
    """Every table of the country tabs: totals, curves, axes, growth lines and doubling times.

    The column ``Comparacion`` tells the sets of peers apart, so that one pass over the
    curves serves all of them. Deaths are selected on the newest date of the cases. Curves and lines have
    the count as it is ``drawn``: null outside the axis of their chart. The tables are separate plans; with
    ``store``, a path, each input is scanned once, in one job, and all tables read what it wrote there.
    """
    if comparisons is None:
        comparisons = {"referencia": REFERENCE_COUNTRIES, "sudamerica": SOUTH_AMERICA}
    members = {name: [focal, *peers] for name, peers in comparisons.items()}
    latest = last_column(confirmed)
    newest = parse_mdy(F.lit(latest))
    header = update_label(newest).alias("header")
    tables = {"encabezado": confirmed.sparkSession.range(1).select(header)}
    inputs = {"confirmados": confirmed, "fallecidos": deaths}
    stored = stored_series(inputs, store) if store is not None else {}
    beyond = F.coalesce(
        *[F.when(F.col("Comparacion") == name, days) for name, days in DAYS_BEYOND.items()], F.lit(max(DAYS_BEYOND.values()))
    )
    for measure, wide in inputs.items():
        if stored:
            long = stored[measure]
            curves = series_curves(long, newest, threshold).drop("Date")
            value = long.filter((column("Country/Region") == focal) & (F.col("Date") == newest))
            total = value.select(F.col("Count").alias("value"), thousands("Count").alias("shown"))
        else:
            curves = country_curves(wide, threshold, latest=latest)
            total = country_total(wide, focal, latest)
        shown = comparison_sets(curves, "Country", focal, comparisons, "Comparacion")
        times = fan_out_sets(
            doubling_table(curves, "Country", "Count"), "Country", members, "Comparacion"
        )
        axes = axis_domain(shown, "Count", F.max(beyond), by=["Comparacion"])
        lines = growth_lines(shown, "Country", "Count", threshold, COUNTRY_RATES, by=["Comparacion"])
        tables[f"total_{measure}"] = total
        tables[f"curvas_{measure}"] = with_drawn(shown, "Count", axes, ["Comparacion"], LOWEST_DRAWN)
        tables[f"ejes_{measure}"] = axes
        tables[f"lineas_{measure}"] = with_drawn(lines, "Count", axes, ["Comparacion"], LOWEST_DRAWN)
        tables[f"duplicacion_{measure}"] = times.orderBy(
            "Comparacion", "Country"
        ).withColumnRenamed("Country", "País")
    return tables


def newest_record(document: DataFrame, records: str = "confirmados") -> Column:
    """Newest date among the records, as text, for use in filters."""
    dates = document.select(F.explode(column(records)["fecha"]).alias("fecha"))
    return dates.agg(F.max("fecha").alias("fecha")).scalar()


def department_update_day(latest: Column) -> Column:
    """Day before the newest record as ``dd/mm/yy``: the newest day is not shown."""
    return dmy(day_before(parse_iso(latest)))


def department_days(
    document: DataFrame,
    records: str = "confirmados",
    departments: Mapping[str, str] | None = None,
    total_name: str = FOCAL,
) -> DataFrame:
    """A row (Fecha, Dpto, Count) per date and department that the records hold, and their total per date.

    The departments are the keys that occur, renamed where ``departments`` has a name. The total of a
    date is null as soon as one of all these departments is missing on it. A date in several records
    counts once, with the largest count of each department. No list of names is needed, and the table is
    never wide, so further departments change nothing.
    """
    entries = explode_records(document, records, "fecha", "dep", "Dpto", "Count")
    name = recode("Dpto", departments or {})
    once = entries.groupBy(F.col("fecha").alias("Fecha"), name.alias("Dpto")).agg(F.max("Count").alias("Count"))
    complete = F.size(levels_of_series(once, "Dpto", "Count"))
    levels = F.array(
        F.struct(F.col("Dpto"), F.lit(False).alias("whole")), F.struct(F.lit(total_name).alias("Dpto"), F.lit(True).alias("whole"))
    )
    doubled = once.select("Fecha", "Count", F.explode(levels).alias("level"))
    days = doubled.groupBy("Fecha", "level").agg(F.sum("Count").alias("Count"), F.count("Count").alias("n"))
    count = F.when(~F.col("level.whole") | (F.col("n") == complete), F.col("Count"))
    return days.select("Fecha", "level.Dpto", count.alias("Count"))


def curves_of_days(days: DataFrame, latest: Column, threshold: float = THRESHOLD) -> DataFrame:
    """Aligned curves of :func:`department_days` without the newest date."""
    shown = days.filter(F.col("Fecha") != latest).withColumn("Fecha", parse_iso("Fecha"))
    return align_since_threshold(shown, "Dpto", "Fecha", "Count", threshold)


def department_curves(
    document: DataFrame,
    latest: Column,
    records: str = "confirmados",
    departments: Mapping[str, str] | None = None,
    total_name: str = FOCAL,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Aligned curves (Fecha, Dpto, Count, Day, NumDays) of departments and their total.

    ``departments`` maps keys in the records to names; any other key keeps its own. The total of a date is null,
    and drops out, as soon as one department is missing. ``latest`` is left out because
    it may repeat the day before. Windows hold a row per date and department at most.
    """
    return curves_of_days(department_days(document, records, departments, total_name), latest, threshold)


def department_tracker(
    document: DataFrame,
    departments: Mapping[str, str] | None = None,
    focal: str = FOCAL,
    threshold: float = THRESHOLD,
) -> dict[str, DataFrame]:
    """Every table of the department tab; deaths leave out the newest date of the cases."""
    days = {records: department_days(document, records, departments, focal) for records in ("confirmados", "decesos")}
    latest = latest_of_series(days["confirmados"], "Fecha", "Count")
    header = update_label(day_before(parse_iso(latest))).alias("header")
    tables = {"encabezado": document.sparkSession.range(1).select(header)}
    for records, series in days.items():
        curves = curves_of_days(series, latest, threshold)
        levels = levels_of_series(series, "Dpto", "Count")
        rank = F.size(levels).cast("bigint") + 1 - F.array_position(levels, F.col("Dpto"))
        labelled = label_last_day(curves, "Dpto").withColumn("Dpto_ord", rank)
        axes = axis_domain(curves, "Count")
        lines = growth_lines(curves, "Dpto", "Count", threshold, DEPARTMENT_RATES)
        times = with_focal_order(doubling_table(curves, "Dpto", "Count"), "Dpto", focal)
        tables[f"curvas_{records}"] = with_drawn(labelled, "Count", axes, low=LOWEST_DRAWN)
        tables[f"ejes_{records}"] = axes
        tables[f"lineas_{records}"] = with_drawn(lines, "Count", axes, low=LOWEST_DRAWN)
        tables[f"duplicacion_{records}"] = times.orderBy("Dpto_ord")
    return tables
