"""Queries on cohorts, doubling times and growth lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.catalog.inputs import (
    NATION_COHORT_SQL,
    NATION_QUARTERS_SQL,
    event_cohort,
    event_cohort_sql,
    event_runs,
    event_series,
    iso,
    nation_cohort,
    nation_quarters,
    table,
    wide_case_series,
)
from cohortline.catalog.registry import register
from cohortline.functions import doubling_growth, thousands
from cohortline.operators.cohort import align_since_threshold, comparison_subset, label_maximum
from cohortline.operators.doubling import (
    doubling_table,
    focal_first,
    interval_ends,
    printed_table,
    times_of_ends,
)
from cohortline.operators.growth import COUNTRY_RATES, DEPARTMENT_RATES, growth_lines
from cohortline.operators.latest import latest_of_series, value_at_latest
from cohortline.operators.long_series import align_by_span, running_total_by_span
from cohortline.operators.overlay import axis_domain, clip_counts
from cohortline.operators.refresh import cohort_state, refreshed_state, state_ends
from cohortline.operators.series import count_by_date, running_total
from cohortline.operators.stacking import overlay
from cohortline.plans.tracker import country_curves, country_total

USER_COHORT_SQL = event_cohort_sql("user_id")
TYPE_COHORT_SQL = event_cohort_sql("event_type")

FOCAL = "NATION_0"
PEERS = ["NATION_1", "NATION_5", "NATION_7"]


def doubling_cells() -> tuple[str, str]:
    """Aggregates and cells of a doubling table, by looking up rows from the end of each entity."""
    headers = [
        "Última Semana",
        "Penúltima Semana",
        "Antepenúltima Semana",
        "Trasantepenúltima Semana",
    ]
    points = ", ".join(
        f"max(cnt) FILTER (WHERE rn = nd - {7 * k}) AS c{k}" for k in range(len(headers) + 1)
    )
    cells = ", ".join(
        f"""CASE WHEN nd = 1 OR c{k} = c{k + 1} THEN 'Sin Cambio'
             WHEN c{k} IS NULL OR c{k + 1} IS NULL THEN 'NA'
             ELSE CAST(CAST(round_even(7 * ln(2) / ln(c{k} / c{k + 1}), 0) AS BIGINT) AS VARCHAR)
                  || ' días' END AS "{h}\""""
        for k, h in enumerate(headers)
    )
    return points, cells


def doubling_sql(cohort: str, entity: str, rows: str = "coh") -> str:
    """Doubling table from a cohort CTE."""
    points, cells = doubling_cells()
    return f"""WITH {cohort},
ends AS (SELECT {entity}, max(nd) AS nd, {points} FROM {rows} GROUP BY {entity})
SELECT {entity}, {cells} FROM ends"""


def _lines_sql(cohort: str, rates: dict[str, int], entity: str, rows: str = "coh") -> str:
    values = ", ".join(f"('{name}', {rate})" for name, rate in rates.items())
    return f"""{cohort},
horizon AS (SELECT max(rn) + 10 AS m FROM {rows}),
rates(name, rate) AS (VALUES {values}),
pts AS (
  SELECT name, round_even(10 * pow(2.0, t / rate), 0) AS cnt, t, m
  FROM horizon, rates, LATERAL (SELECT unnest(range(0, m + 1)) AS t)),
lines AS (
  SELECT name AS {entity}, cnt AS "Count", CAST(t + 1 AS INTEGER) AS "Day",
         CAST(m + 1 AS INTEGER) AS "NumDays",
         CASE WHEN cnt = max(cnt) OVER (PARTITION BY name) THEN name END AS label
  FROM pts)"""


@register(
    "A2 F6 W1 W2 O1",
    f"""WITH {USER_COHORT_SQL}
SELECT user_id, CAST(d AS VARCHAR) AS date, cnt AS "Count", rn AS "Day", nd AS "NumDays" FROM coh""",
)
def cohort_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' cumulative events, numbered from the tenth one on."""
    cohort = event_cohort(spark, sf_dir, "user_id")
    return cohort.select("user_id", iso("date"), "Count", "Day", "NumDays")


@register(
    "A1 F6 F7 W1 W2 O2",
    f"""WITH {NATION_QUARTERS_SQL},
kept AS (
  SELECT n_name, d, n FROM nq
  WHERE n >= 8 AND n_name IN (
    SELECT n_name FROM nq WHERE d = (SELECT max(d) FROM nq) GROUP BY n_name HAVING sum(n) >= 8))
SELECT n_name, CAST(d AS VARCHAR) AS date, n AS "Count",
       CAST(row_number() OVER (PARTITION BY n_name ORDER BY d) AS INTEGER) AS "Day",
       CAST(count(*) OVER (PARTITION BY n_name) AS INTEGER) AS "NumDays"
FROM kept""",
)
def cohort_nations_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with at least eight orders in the newest quarter, and their quarters of eight or more."""
    series = nation_quarters(spark, sf_dir)
    newest = latest_of_series(series, "date", "Count")
    cohort = align_since_threshold(series, "n_name", "date", "Count", 8, newest)
    return cohort.select("n_name", iso("date"), "Count", "Day", "NumDays")


SPANISH_NAMES = {
    "Korea, South": "Corea del Sur",
    "US": "EEUU",
    "Italy": "Italia",
    "Spain": "España",
    "Brazil": "Brasil",
}


def places_sql(
    status: str | None = None, name: str = "aligned", threshold: int = 10, names: dict[str, str] = SPANISH_NAMES
) -> str:
    """Common table expressions ending in the aligned curves of all orders or of one status."""
    renamed = " ".join(f"WHEN country = '{old}' THEN '{new}'" for old, new in names.items())
    chosen = f"WHERE o_orderstatus = '{status}'" if status else ""
    return f"""
quarters_{name} AS (
  SELECT CAST(unnest(generate_series(
           date_trunc('quarter', min(o_orderdate)), date_trunc('quarter', max(o_orderdate)),
           INTERVAL 3 MONTH)) AS DATE) AS q FROM orders),
placed_{name} AS (
  SELECT CASE n_name WHEN 'NATION_0' THEN 'Bolivia' WHEN 'NATION_1' THEN 'Korea, South'
              WHEN 'NATION_2' THEN 'US' WHEN 'NATION_3' THEN 'Italy' WHEN 'NATION_4' THEN 'Spain'
              WHEN 'NATION_5' THEN 'Brazil' WHEN 'NATION_6' THEN 'Ecuador'
              WHEN 'NATION_7' THEN 'China' ELSE n_name END AS country,
         CASE WHEN n_name = 'NATION_7' AND c_mktsegment = 'BUILDING' THEN 'Hong Kong'
              ELSE c_mktsegment END AS province,
         CAST(o_orderdate AS DATE) AS od
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  {chosen}),
named_{name} AS (
  SELECT CASE WHEN province = 'Hong Kong' THEN 'Hong Kong' {renamed} ELSE country END AS country, od
  FROM placed_{name}),
curve_{name} AS (
  SELECT country, q, sum(n) OVER (PARTITION BY country ORDER BY q) AS cnt
  FROM (SELECT c.country, t.q, count(od) AS n
        FROM (SELECT DISTINCT country FROM named_{name}) c CROSS JOIN quarters_{name} t
        LEFT JOIN named_{name} x ON x.country = c.country AND date_trunc('quarter', x.od) = t.q
        GROUP BY 1, 2)),
{name} AS (
  SELECT country, q, CAST(cnt AS DOUBLE) AS cnt,
         CAST(row_number() OVER (PARTITION BY country ORDER BY q) AS INTEGER) AS rn,
         CAST(count(*) OVER (PARTITION BY country) AS INTEGER) AS nd
  FROM curve_{name} WHERE cnt >= {threshold})"""


PLACES_SQL = places_sql()


@register(
    "P2 P3 P8 P9 C1 C2 A1 F7 R1 R3 D1 F6 W1 W2 G5",
    f"""WITH {PLACES_SQL}
SELECT country AS "Country", CAST(q AS VARCHAR) AS date, cnt AS "Count", rn AS "Day", nd AS "NumDays"
FROM aligned""",
)
def country_curves_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracker's cohort preparation on a wide series with a promoted province."""
    curves = country_curves(wide_case_series(spark, sf_dir), keep_date=True)
    return curves.select(
        "Country", F.col("Date").cast("string").alias("date"), "Count", "Day", "NumDays"
    )


@register(
    "F1 A10 P8 P9 P10 D15",
    """SELECT CAST(count(*) AS DOUBLE) AS value, format('{:,}', count(*)) AS shown
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE n_name = 'NATION_0' GROUP BY c_mktsegment""",
)
def country_total_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest value of one country in a wide series, one row per place."""
    return country_total(wide_case_series(spark, sf_dir))


@register(
    "A10 O2 D15",
    f"""WITH {NATION_COHORT_SQL}
SELECT n_name, CAST(max(d) AS VARCHAR) AS date, arg_max(cnt, d) AS "Count",
       format('{{:,}}', arg_max(cnt, d)) AS shown
FROM ncum GROUP BY n_name""",
)
def kpi_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest cumulative orders per nation, plain and with separators."""


    series = running_total(nation_quarters(spark, sf_dir), "n_name", "date", "Count")
    newest = value_at_latest(series, "date", "Count", "n_name")
    return newest.select("n_name", iso("date"), "Count", thousands("Count").alias("shown"))


@register(
    "F3 W3 O4 G7",
    f"""WITH {NATION_COHORT_SQL}
SELECT n_name, CAST(d AS VARCHAR) AS date, cnt AS "Count", rn AS "Day", nd AS "NumDays",
       CASE WHEN rn = max(rn) OVER (PARTITION BY n_name) THEN n_name END AS label,
       CAST(5 - list_position(['NATION_0', 'NATION_1', 'NATION_5', 'NATION_7'], n_name) AS BIGINT)
         AS n_name_ord
FROM ncoh WHERE n_name IN ('NATION_0', 'NATION_1', 'NATION_5', 'NATION_7')""",
)
def comparison_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A focal nation and three peers, labelled on the last row."""
    subset = comparison_subset(nation_cohort(spark, sf_dir), "n_name", FOCAL, PEERS)
    return subset.withColumn("date", iso("date"))


@register(
    "W4",
    f"""WITH {USER_COHORT_SQL}
SELECT user_id, CAST(d AS VARCHAR) AS date, cnt AS "Count", rn AS "Day",
       CASE WHEN cnt = max(cnt) OVER (PARTITION BY user_id) THEN user_id END AS label
FROM coh""",
)
def maximum_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users labelled on every day that holds their maximum."""
    labelled = label_maximum(event_cohort(spark, sf_dir, "user_id"), "user_id", "Count")
    return labelled.select("user_id", iso("date"), "Count", "Day", "label")


@register(
    "W7 R5",
    f"""WITH {USER_COHORT_SQL}
SELECT user_id, max(nd) AS "NumDays",
       CAST(max(cnt) FILTER (WHERE rn = nd) AS DOUBLE) AS end_0,
       CAST(max(cnt) FILTER (WHERE rn = nd - 7) AS DOUBLE) AS end_1,
       CAST(max(cnt) FILTER (WHERE rn = nd - 14) AS DOUBLE) AS end_2,
       CAST(max(cnt) FILTER (WHERE rn = nd - 21) AS DOUBLE) AS end_3
FROM coh GROUP BY user_id""",
)
def interval_ends_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' counts at the last day and one, two and three weeks before it."""
    return interval_ends(event_runs(spark, sf_dir, "user_id"), "user_id", "Count", intervals=3)


@register(
    "W7 G3 G4 C6 C7 C8 P4 P11 D6 D9 D13 R5 K2", doubling_sql(USER_COHORT_SQL, "user_id")
)
def doubling_time_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly doubling times of users' cumulative events (flagship)."""
    return doubling_table(event_runs(spark, sf_dir, "user_id"), "user_id", "Count")


@register("G5 W7 G3 G4 W1 W2", doubling_sql(USER_COHORT_SQL, "user_id"))
def refreshed_doubling_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubling times from a state of three days ago, refreshed by new days and by corrections of old ones."""
    series = event_series(spark, sf_dir, "user_id")
    newest = latest_of_series(series, "date", "Count")
    old = F.col("date") <= F.date_sub(newest, 3)
    wrong = (F.col("user_id") % 7 == 0) & (F.col("date") == F.date_sub(newest, 9))
    before = series.filter(old).withColumn("Count", F.when(wrong, F.col("Count") - 1).otherwise(F.col("Count")))
    state = cohort_state(before, "user_id", "date", "Count", 10)
    changes = series.filter(~old | wrong)
    refreshed = refreshed_state(state, changes, series, "user_id", "date", "Count", 10)
    return printed_table(times_of_ends(state_ends(refreshed, "user_id"), "user_id"))


@register(
    "W1 W2 F6 O1",
    """WITH daily AS (SELECT event_type, ts, count(*) AS n FROM events GROUP BY ALL),
cum AS (SELECT event_type, ts, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY ts) AS BIGINT) AS cnt FROM daily)
SELECT event_type, CAST(ts AS VARCHAR) AS moment, cnt AS "Count",
       row_number() OVER (PARTITION BY event_type ORDER BY ts) AS "Day", count(*) OVER (PARTITION BY event_type) AS "NumDays"
FROM cum WHERE cnt >= 10""",
)
def cohort_of_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types by the moment, not the day: running total and numbering in ranges of an hour."""
    counts = count_by_date(table(spark, sf_dir, "events"), "event_type", F.col("ts"), "ts", "Count")
    hour = F.date_trunc("hour", "ts")
    totals = running_total_by_span(counts, "event_type", "ts", "Count", hour)
    cohort = align_by_span(totals, "event_type", "ts", "Count", 10, hour)
    return cohort.select("event_type", F.col("ts").cast("string").alias("moment"), "Count", "Day", "NumDays")


@register("W7 G3 G4 C6 C7 C8 P11", doubling_sql(TYPE_COHORT_SQL, "event_type"))
def doubling_time_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly doubling times of event types."""
    return doubling_table(event_runs(spark, sf_dir, "event_type"), "event_type", "Count")


@register("G4 O5 U4", doubling_sql(NATION_COHORT_SQL, "n_name", "ncoh"))
def doubling_time_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubling times over seven quarters, the focal nation on top."""
    times = doubling_table(nation_cohort(spark, sf_dir), "n_name", "Count")
    return focal_first(times, "n_name", FOCAL)


@register(
    "A8 D7 D9 D16 J5 G1 G2 W4 W8 R2b",
    f"WITH {_lines_sql(USER_COHORT_SQL, COUNTRY_RATES, 'user')} SELECT * FROM lines",
)
def growth_lines_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference lines as long as the longest user cohort, five rates."""
    cohort = event_runs(spark, sf_dir, "user_id")
    return growth_lines(cohort, "user", "Count", 10, COUNTRY_RATES)


@register(
    "A8 D7 D9 D16 J5 G1 G2 W4 W8 R2b",
    f"WITH {_lines_sql(TYPE_COHORT_SQL, DEPARTMENT_RATES, 'event_type')} SELECT * FROM lines",
)
def growth_lines_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference lines for the event types, six rates."""
    cohort = event_runs(spark, sf_dir, "event_type")
    return growth_lines(cohort, "event_type", "Count", 10, DEPARTMENT_RATES)


@register(
    "G1 D7",
    f"""WITH {USER_COHORT_SQL}
SELECT user_id, rn AS "Day", CAST(cnt AS DOUBLE) AS "Count",
       round_even(cnt * pow(2.0, 7 / nd), 0) AS projected
FROM coh""",
)
def projected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each count a week ahead if it doubled once per length of its cohort."""
    return event_cohort(spark, sf_dir, "user_id").select(
        "user_id",
        "Day",
        F.col("Count").cast("double").alias("Count"),
        doubling_growth(F.col("Count"), "NumDays", F.lit(7)).alias("projected"),
    )


@register(
    "J6 U1",
    f"""WITH {_lines_sql(NATION_COHORT_SQL, COUNTRY_RATES, 'n_name', 'ncoh')}
SELECT n_name, CAST(cnt AS DOUBLE) AS "Count", rn AS "Day", nd AS "NumDays",
       CASE WHEN rn = nd THEN n_name END AS label, 'curves' AS layer
FROM ncoh WHERE n_name IN ('NATION_0', 'NATION_1', 'NATION_5', 'NATION_7')
UNION ALL SELECT n_name, "Count", "Day", "NumDays", label, 'lines' FROM lines""",
)
def overlay_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation curves and growth lines as two layers of one chart."""
    cohort = nation_cohort(spark, sf_dir)
    columns = ["n_name", "Count", "Day", "NumDays", "label"]
    curves = comparison_subset(cohort, "n_name", FOCAL, PEERS).select(*columns)
    curves = curves.withColumn("Count", F.col("Count").cast("double"))
    return overlay({"curves": curves, "lines": growth_lines(cohort, "n_name", "Count", 10)})


@register(
    "F12 A11",
    f"""WITH {_lines_sql(USER_COHORT_SQL, COUNTRY_RATES, 'user')},
top AS (SELECT pow(10.0, ceil(log10(max(cnt))) + 1) AS hi FROM coh)
SELECT "user", "Day", CASE WHEN "Count" BETWEEN 10 AND hi THEN "Count" END AS "Count"
FROM lines, top""",
)
def clipped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth lines cut off at the decade above the largest user count."""
    cohort = event_runs(spark, sf_dir, "user_id")
    lines = growth_lines(cohort, "user", "Count", 10).select("user", "Day", "Count")
    return clip_counts(lines, "Count", cohort)


@register(
    "A11 A8 D7",
    f"""WITH {USER_COHORT_SQL}
SELECT CAST(max(nd) AS BIGINT) AS last_day, CAST(max(nd) + 30 AS BIGINT) AS last_break,
       CAST(max(cnt) AS DOUBLE) AS largest, CAST(ceil(log10(max(cnt))) AS BIGINT) AS top_decade,
       pow(10.0, ceil(log10(max(cnt))) + 1) AS upper_limit
FROM coh""",
)
def axis_domain_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of the chart axes for the user cohort."""
    return axis_domain(event_runs(spark, sf_dir, "user_id"), "Count")


