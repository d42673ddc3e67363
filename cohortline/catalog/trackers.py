"""Queries that run the whole trackers, every table of a kind stacked under its name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.catalog.cohorts import doubling_cells, places_sql
from cohortline.catalog.inputs import wide_case_series
from cohortline.catalog.panels import DEPARTMENT_SQL, EVENT_TYPES, event_records
from cohortline.catalog.registry import register
from cohortline.operators.growth import DEPARTMENT_RATES
from cohortline.operators.stacking import bind_rows, overlay
from cohortline.plans.tracker import (
    DAYS_BEYOND,
    FOCAL,
    REFERENCE_COUNTRIES,
    SOUTH_AMERICA,
    country_tracker,
    department_tracker,
)
from cohortline.session import scratch_path

COMPARISONS = {
    "referencia": [FOCAL, *REFERENCE_COUNTRIES],
    "sudamerica": [FOCAL, *SOUTH_AMERICA],
}
MEASURES_SQL = f"{places_sql(None, 'confirmados')}, {places_sql('F', 'fallecidos')}"


def tracker_tables(spark: SparkSession, sf_dir: str, kind: str) -> dict[str, DataFrame]:
    """The country tracker's tables of one kind; finished orders play the deaths."""
    confirmed = wide_case_series(spark, sf_dir)
    deaths = wide_case_series(spark, sf_dir, status="F")
    tables = country_tracker(confirmed, deaths)
    return {name: df for name, df in tables.items() if kind in name}


def _stacked_sql(select: str) -> str:
    """One SELECT per measure and comparison."""
    parts = []
    for measure in ("confirmados", "fallecidos"):
        for comparison, names in COMPARISONS.items():
            listed = ", ".join(f"'{n}'" for n in names)
            parts.append(
                select.format(
                    rows=measure, comparison=comparison, names=listed, last=len(names) + 1,
                    beyond=DAYS_BEYOND[comparison],
                    upper=f"(SELECT pow(10, ceil(log10(max(cnt))) + 1) FROM {measure} WHERE country IN ({listed}))",
                )
            )
    return f"WITH {MEASURES_SQL} " + " UNION ALL ".join(parts)


_CURVES_SQL = """SELECT 'curvas_{rows}' AS layer, '{comparison}' AS "Comparacion", country AS "Country",
       cnt AS "Count", rn AS "Day", nd AS "NumDays", CASE WHEN rn = nd THEN country END AS label,
       CAST({last} - list_position([{names}], country) AS BIGINT) AS "Country_ord",
       CASE WHEN cnt BETWEEN 10 AND {upper} THEN cnt END AS drawn
FROM {rows} WHERE country IN ({names})"""


@register("G5 G7 F3 W1 W2 W3 O4 F7 C1 C2", _stacked_sql(_CURVES_SQL))
def country_tracker_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases and deaths of the focal country against both comparison sets."""
    return overlay(tracker_tables(spark, sf_dir, "curvas_"))


@register("K1 S8 G5 G7 W1 W2 W3 O4 F7", _stacked_sql(_CURVES_SQL))
def stored_tracker_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same curves from series that are written once for all tables."""
    confirmed, deaths = wide_case_series(spark, sf_dir), wide_case_series(spark, sf_dir, status="F")
    tables = country_tracker(confirmed, deaths, store=scratch_path(spark, "series"))
    return overlay({name: df for name, df in tables.items() if "curvas_" in name})


_AXES_SQL = """SELECT 'ejes_{rows}' AS layer, '{comparison}' AS "Comparacion", CAST(max(nd) AS BIGINT) AS last_day,
       CAST(max(nd) + {beyond} AS BIGINT) AS last_break, max(cnt) AS largest,
       CAST(ceil(log10(max(cnt))) AS BIGINT) AS top_decade, pow(10, ceil(log10(max(cnt))) + 1) AS upper_limit
FROM {rows} WHERE country IN ({names}) HAVING count(*) > 0"""


@register("A11 A8 F12 D7", _stacked_sql(_AXES_SQL))
def country_tracker_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of the axes of every chart of the country tabs."""
    return overlay(tracker_tables(spark, sf_dir, "ejes_"))


_LINES_SQL = """SELECT 'lineas_{rows}' AS layer, '{comparison}' AS "Comparacion", name AS "Country",
       round_even(10 * pow(2.0, t / rate), 0) AS "Count", CAST(t + 1 AS INTEGER) AS "Day",
       CAST(m + 1 AS INTEGER) AS "NumDays",
       CASE WHEN round_even(10 * pow(2.0, t / rate), 0) = round_even(10 * pow(2.0, m / rate), 0)
            THEN name END AS label,
       CASE WHEN round_even(10 * pow(2.0, t / rate), 0) BETWEEN 10 AND {upper}
            THEN round_even(10 * pow(2.0, t / rate), 0) END AS drawn
FROM (SELECT max(nd) + 10 AS m FROM {rows} WHERE country IN ({names})),
     (VALUES ('cada_dia', 1), ('cada_dos_dias', 2), ('cada_tres_dias', 3), ('cada_semana', 7),
             ('cada_mes', 30)) r(name, rate),
     LATERAL (SELECT unnest(range(0, m + 1)) AS t)"""


@register("G2 G1 J5 D16 W4 W8", _stacked_sql(_LINES_SQL))
def country_tracker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth lines under the curves of both measures and comparison sets."""
    return overlay(tracker_tables(spark, sf_dir, "lineas_"))


_POINTS, _CELLS = doubling_cells()
_DOUBLING_SQL = f"""SELECT 'duplicacion_{{rows}}' AS layer, '{{comparison}}' AS "Comparacion",
       country AS "País", {_CELLS}
FROM (SELECT country, max(nd) AS nd, {_POINTS} FROM {{rows}}
      WHERE country IN ({{names}}) GROUP BY country)"""


@register("G3 G4 W7 K2 P4", _stacked_sql(_DOUBLING_SQL))
def country_tracker_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubling tables of cases and deaths for both comparison sets."""
    return overlay(tracker_tables(spark, sf_dir, "duplicacion_"))


_TOTALS_SQL = """WITH places AS (
  SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE n_name = 'NATION_0' GROUP BY 1)
SELECT 'total_confirmados' AS layer, CAST(n AS DOUBLE) AS value, format('{:,}', n) AS shown FROM places
UNION ALL
SELECT 'total_fallecidos', CAST(f AS DOUBLE), format('{:,}', f) FROM places"""


@register("A10 D15 P8 P9", _TOTALS_SQL)
def country_tracker_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest cases and deaths of the focal country."""
    return overlay(tracker_tables(spark, sf_dir, "total_"))


# --- departments ----------------------------------------------------------------------

# Events of at least this value play the deaths.
DEATH_VALUE = 20


def tracker_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the records of all events as cases or of the valuable ones as deaths."""
    none = F.expr("CAST(array() AS array<struct<fecha:string,dep:map<string,double>>>)")
    records = F.col("records")
    cases = event_records(spark, sf_dir)
    deaths = event_records(spark, sf_dir, DEATH_VALUE)
    return bind_rows(
        cases.select(records.alias("confirmados"), none.alias("decesos")),
        deaths.select(none.alias("confirmados"), records.alias("decesos")),
    )


def _levels_sql(name: str, condition: str) -> str:
    return f"""
types_{name} AS (SELECT DISTINCT event_type AS kind, {DEPARTMENT_SQL} AS dep FROM events e WHERE {condition}),
names_{name} AS (SELECT list(dep ORDER BY dep) AS names FROM (SELECT dep FROM types_{name} UNION SELECT 'Bolivia')),
cells_{name} AS (
  SELECT d, dep, nullif((SELECT count(*) FROM events e WHERE e.event_type = t.kind
                         AND CAST(e.ts AS DATE) <= d AND {condition}), 0) AS n
  FROM days, types_{name} t),
levels_{name} AS (
  SELECT d, dep, n FROM cells_{name}
  UNION ALL SELECT d, 'Bolivia', CASE WHEN count(n) = count(*) THEN sum(n) END
  FROM cells_{name} GROUP BY d),
{name} AS (
  SELECT d, dep, CAST(n AS DOUBLE) AS cnt,
         CAST(row_number() OVER (PARTITION BY dep ORDER BY d) AS INTEGER) AS rn,
         CAST(count(*) OVER (PARTITION BY dep) AS INTEGER) AS nd
  FROM levels_{name} WHERE n >= 10 AND d <> (SELECT max(d) FROM days))"""


_DEPARTMENT_SQL = f"""WITH days AS (
  SELECT CAST(unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)),
         INTERVAL 1 DAY)) AS DATE) AS d FROM events),
{_levels_sql("confirmados", "true")},
{_levels_sql("decesos", f"e.value >= {DEATH_VALUE}")}
"""


def department_tables(spark: SparkSession, sf_dir: str, kind: str) -> dict[str, DataFrame]:
    tables = department_tracker(tracker_document(spark, sf_dir), EVENT_TYPES)
    return {name: df for name, df in tables.items() if kind in name}


@register(
    "G6 W3 O4 O6 F2 S6",
    _DEPARTMENT_SQL
    + " UNION ALL ".join(
        f"""SELECT 'curvas_{name}' AS layer, CAST(d AS VARCHAR) AS "Fecha", dep AS "Dpto",
       cnt AS "Count", rn AS "Day", nd AS "NumDays", CASE WHEN rn = nd THEN dep END AS label,
       CAST(len(names) + 1 - list_position(names, dep) AS BIGINT) AS "Dpto_ord",
       CASE WHEN cnt BETWEEN 10 AND (SELECT pow(10, ceil(log10(max(cnt))) + 1) FROM {name}) THEN cnt END AS drawn
FROM {name}, names_{name}"""
        for name in ("confirmados", "decesos")
    ),
)
def department_tracker_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases and deaths per department and in total."""
    curves = overlay(department_tables(spark, sf_dir, "curvas_"))
    return curves.withColumn("Fecha", F.col("Fecha").cast("string"))


@register(
    "G3 G4 O5 U4",
    _DEPARTMENT_SQL
    + " UNION ALL ".join(
        f"""SELECT 'duplicacion_{name}' AS layer, dep AS "Dpto", {_CELLS},
       CASE WHEN dep = 'Bolivia' THEN 1 ELSE 1 + row_number() OVER (PARTITION BY dep = 'Bolivia' ORDER BY dep) END AS "Dpto_ord"
FROM (SELECT dep, max(nd) AS nd, {_POINTS} FROM {name} GROUP BY dep)"""
        for name in ("confirmados", "decesos")
    ),
)
def department_tracker_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubling tables of cases and deaths per department."""
    return overlay(department_tables(spark, sf_dir, "duplicacion_"))


@register(
    "A11 A8 F12 D7",
    _DEPARTMENT_SQL
    + " UNION ALL ".join(
        f"""SELECT 'ejes_{name}' AS layer, CAST(max(nd) AS BIGINT) AS last_day, CAST(max(nd) + 30 AS BIGINT) AS last_break,
       max(cnt) AS largest, CAST(ceil(log10(max(cnt))) AS BIGINT) AS top_decade,
       pow(10, ceil(log10(max(cnt))) + 1) AS upper_limit
FROM {name}"""
        for name in ("confirmados", "decesos")
    ),
)
def department_tracker_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of the axes of both charts of the department tab."""
    return overlay(department_tables(spark, sf_dir, "ejes_"))


_RATES = ", ".join(f"('{name}', {rate})" for name, rate in DEPARTMENT_RATES.items())


@register(
    "G2 G1 J5 D16 W4 W8 F12",
    _DEPARTMENT_SQL
    + " UNION ALL ".join(
        f"""SELECT 'lineas_{name}' AS layer, rates.name AS "Dpto", v AS "Count", CAST(t + 1 AS INTEGER) AS "Day",
       CAST(m + 1 AS INTEGER) AS "NumDays", CASE WHEN v = round_even(10 * pow(2.0, m / rate), 0) THEN rates.name END AS label,
       CASE WHEN v BETWEEN 10 AND (SELECT pow(10, ceil(log10(max(cnt))) + 1) FROM {name}) THEN v END AS drawn
FROM (SELECT max(nd) + 10 AS m FROM {name}), (VALUES {_RATES}) rates(name, rate),
     LATERAL (SELECT unnest(range(0, m + 1)) AS t), LATERAL (SELECT round_even(10 * pow(2.0, t / rate), 0) AS v)"""
        for name in ("confirmados", "decesos")
    ),
)
def department_tracker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth lines of the department tab, as long as its axes."""
    return overlay(department_tables(spark, sf_dir, "lineas_"))
