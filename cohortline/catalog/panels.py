"""Queries on levels, reshaping, benchmarks and the whole panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.catalog.inputs import (
    MONEY,
    NATION_YEARS_SQL,
    event_series,
    from_year,
    hundredths,
    iso,
    nation_years,
    order_span,
    orders_by_place,
    quarter_start,
    table,
    wide_case_series,
)
from cohortline.catalog.cohorts import PLACES_SQL, places_sql
from cohortline.catalog.registry import register
from cohortline.functions import (
    band_of,
    benchmark_class,
    horizontal_sum,
    level_rank,
    ratio,
    recode,
    strict_mean,
    strict_sum,
    sum_or_zero,
    within_any_band,
)
from cohortline.operators.benchmark import (
    group_mean,
    keep_members,
    members,
    ratio_to_base,
    segment_rates,
    share_of_total,
    weighted_by_population,
    weighted_rate,
    with_group_total,
)
from cohortline.operators.latest import drop_latest, keep_latest
from cohortline.operators.matching import match_losses
from cohortline.operators.reshape import explode_records, found_levels, level_map, spread
from cohortline.operators.stacking import bind_rows, with_total_level
from cohortline.plans.panels import (
    education_panel,
    gdp_panel,
    newest_labels,
    regime_panel,
    satisfaction_panel,
    vaccination_panel,
)
from cohortline.plans.stringency import PRINTED_NAMES, SERIES_NAMES, SHOWN, joined_overlay, stringency_overlay
from cohortline.plans.tracker import country_curves, department_curves, newest_record
from cohortline.sources.csv_files import melt_years

def decimals_sql(value: str, digits: int) -> str:
    """The nearer neighbour of so many decimals, the even one of two that are equally near."""
    p = float(10**digits)
    low, high = f"floor({value} * {p}) / {p}", f"ceil({value} * {p}) / {p}"
    return f"""CASE WHEN {value} - {low} < {high} - {value} THEN {low} WHEN {value} - {low} > {high} - {value} THEN {high}
            WHEN floor({value} * {p})::BIGINT % 2 = 0 THEN {low} ELSE {high} END"""


def year_names(spark: SparkSession, sf_dir: str) -> list[str]:
    """Year column names, newest first, as the wide yearly tables have them."""
    first, last = order_span(spark, sf_dir)
    return [str(y) for y in range(last.year, first.year - 1, -1)]


def region_nations(spark: SparkSession, sf_dir: str, region: str) -> DataFrame:
    """Keys of the regions with the name; nations refer to them."""
    return members(table(spark, sf_dir, "region"), "r_regionkey", F.col("r_name") == region)


def american_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code set of nation names in the region AMERICA."""
    nations = table(spark, sf_dir, "nation")
    kept = keep_members(nations, region_nations(spark, sf_dir, "AMERICA"), "n_regionkey")
    return members(kept, "n_name", F.lit(True))


AMERICA_SQL = """(SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey
                  WHERE r_name = 'AMERICA')"""


# --- levels and newest date -----------------------------------------------------------


@register(
    "P7 U1 A1",
    """WITH nm AS (
  SELECT n_name, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS d,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amount
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2)
SELECT n_name, CAST(d AS VARCHAR) AS date, CAST(amount AS DOUBLE) AS amount FROM nm
UNION ALL SELECT 'Total', CAST(d AS VARCHAR), CAST(sum(amount) AS DOUBLE) FROM nm GROUP BY d""",
)
def total_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value per nation and quarter plus a row for all nations together."""
    placed = orders_by_place(spark, sf_dir, quarter_start("o_orderdate"), "n_name")
    rows = placed.select("n_name", F.col("period").alias("date"), "cents")
    levels = with_total_level(rows, "n_name", ["date"], "cents", "Total")
    return levels.select("n_name", iso("date"), (F.col("cents") / 100).alias("amount"))


@register(
    "P7 R3",
    """WITH counts AS (
  SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2),
totals AS (
  SELECT date, CASE WHEN count(*) = (SELECT count(DISTINCT o_orderstatus) FROM orders)
                    THEN CAST(sum(n) AS BIGINT) END AS total FROM counts GROUP BY date)
SELECT * FROM (PIVOT counts ON o_orderstatus USING max(n) GROUP BY date) JOIN totals USING (date)""",
)
def horizontal_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per day with a column for each status that occurs, and a total that is missing when a status is."""
    orders = table(spark, sf_dir, "orders")
    counts = orders.groupBy(F.to_date("o_orderdate").alias("date"), "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n")
    )
    statuses = found_levels(orders, "o_orderstatus")
    wide = spread(counts, ["date"], "o_orderstatus", statuses, "n")
    return wide.withColumn("total", horizontal_sum(statuses)).withColumn("date", iso("date"))


@register(
    "F2 O2",
    """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, count(*) AS orders
FROM orders WHERE CAST(o_orderdate AS DATE) <> (SELECT CAST(max(o_orderdate) AS DATE) FROM orders) GROUP BY 1""",
)
def drop_latest_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per day without the newest day."""
    kept = drop_latest(table(spark, sf_dir, "orders"), "o_orderdate")
    daily = kept.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.count(F.lit(1)).alias("orders")
    )
    return daily.withColumn("date", iso("date"))


@register(
    "F11 A8",
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE CAST(o_orderdate AS DATE) = (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)""",
)
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the newest day."""
    rows = keep_latest(table(spark, sf_dir, "orders"), "o_orderdate")
    return rows.select("o_orderkey", "o_orderstatus", "o_totalprice")


# --- reshaping ------------------------------------------------------------------------


@register(
    "R3",
    """WITH counts AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT * FROM (PIVOT counts ON o_orderstatus USING max(n) GROUP BY year)""",
)
def pivot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per year with a column for each status that occurs."""
    orders = table(spark, sf_dir, "orders")
    counts = orders.groupBy(F.year("o_orderdate").alias("year"), "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n")
    )
    return spread(counts, ["year"], "o_orderstatus", found_levels(orders, "o_orderstatus"), "n")


@register(
    "R2 R3 D12 P3",
    f"""WITH {NATION_YEARS_SQL}
SELECT n_name AS "Region", years.y AS year, CAST(n AS INTEGER) AS value
FROM (SELECT DISTINCT n_name FROM ny) CROSS JOIN (
  SELECT CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS y
  FROM (SELECT min(year) AS lo, max(year) AS hi FROM ny)) years
LEFT JOIN ny USING (n_name) WHERE ny.year = years.y
UNION ALL
SELECT m.n_name, m.y, NULL FROM (
  SELECT DISTINCT ny.n_name, years.y FROM ny CROSS JOIN (
    SELECT CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS y
    FROM (SELECT min(year) AS lo, max(year) AS hi FROM ny)) years) m
LEFT JOIN ny ON ny.n_name = m.n_name AND ny.year = m.y WHERE ny.n_name IS NULL""",
)
def unpivot_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per nation from year columns back to rows, empty cells included."""
    return melt_years(wide_years(spark, sf_dir), "Region", "year", "value")


def wide_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with a column of orders per year."""
    counts = nation_years(spark, sf_dir).select(
        F.col("n_name").alias("Region"),
        F.col("year").cast("string").alias("year"),
        F.col("n").cast("int").alias("n"),
    )
    return spread(counts, ["Region"], "year", year_names(spark, sf_dir), "n")


@register(
    "D18 R4 S6",
    """SELECT event_type, 'k' AS key, count(*) AS n,
       CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total
FROM events GROUP BY 1""",
)
def json_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the JSON property maps, added up per event type and key."""
    props = F.from_json("props", "map<string,bigint>")
    entries = table(spark, sf_dir, "events").select("event_type", F.explode(props))
    return entries.groupBy("event_type", "key").agg(
        F.count(F.lit(1)).alias("n"), strict_sum("value").alias("total")
    )


#: Names of event types that play departments; any other type keeps its own.
EVENT_TYPES = {
    "click": "Beni",
    "error": "La Paz",
    "purchase": "Oruro",
    "signup": "Pando",
    "view": "Tarija",
}


def event_records(
    spark: SparkSession, sf_dir: str, least_value: float | None = None
) -> DataFrame:
    """Cumulative events per day as records with a map from event type to count.

    One record per row: all days never meet in one array.
    """
    series = event_series(spark, sf_dir, "event_type", least_value).filter(F.col("Count") > 0)
    counts = series.withColumn("Count", F.col("Count").cast("double"))
    days = level_map(counts, ["date"], "event_type", "Count", "dep")
    record = F.struct(F.col("date").cast("string").alias("fecha"), "dep")
    return days.select(F.array(record).alias("records"))


def department_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose cases and deaths are the same records."""
    records = F.col("records")
    return event_records(spark, sf_dir).select(
        records.alias("confirmados"), records.alias("decesos")
    )


DEPARTMENT_SQL = f"""CASE event_type {
    " ".join(f"WHEN '{kind}' THEN '{name}'" for kind, name in EVENT_TYPES.items())
} ELSE event_type END"""

DEPARTMENTS_SQL = f"""
WITH days AS (
  SELECT CAST(unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)),
         INTERVAL 1 DAY)) AS DATE) AS d FROM events),
types AS (SELECT DISTINCT event_type AS kind, {DEPARTMENT_SQL} AS dep FROM events),
cells AS (
  SELECT d, dep, nullif((SELECT count(*) FROM events e
                         WHERE e.event_type = types.kind AND CAST(e.ts AS DATE) <= d), 0) AS n
  FROM days, types),
levels AS (
  SELECT d, dep, n FROM cells
  UNION ALL SELECT d, 'Bolivia', CASE WHEN count(n) = count(*) THEN sum(n) END FROM cells GROUP BY d),
kept AS (SELECT * FROM levels WHERE n >= 10 AND d <> (SELECT max(d) FROM days))
SELECT CAST(d AS VARCHAR) AS date, dep AS "Dpto", CAST(n AS DOUBLE) AS "Count",
       CAST(row_number() OVER (PARTITION BY dep ORDER BY d) AS INTEGER) AS "Day",
       CAST(count(*) OVER (PARTITION BY dep) AS INTEGER) AS "NumDays"
FROM kept"""


@register("S6 R4 P7 P4 F2 R1 D2 D18 W1 W2 G6", DEPARTMENTS_SQL)
def department_curves_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracker's department preparation with the total of all departments."""
    document = department_document(spark, sf_dir)
    curves = department_curves(document, newest_record(document), departments=EVENT_TYPES)
    return curves.select(
        F.col("Fecha").cast("string").alias("date"), "Dpto", "Count", "Day", "NumDays"
    )


@register(
    "R4 D18 S6",
    """WITH days AS (
  SELECT CAST(unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)),
         INTERVAL 1 DAY)) AS DATE) AS d FROM events)
SELECT CAST(d AS VARCHAR) AS date, event_type,
       CAST((SELECT count(*) FROM events e WHERE e.event_type = t.event_type
             AND CAST(e.ts AS DATE) <= d) AS DOUBLE) AS "Count"
FROM days, (SELECT event_type, CAST(min(ts) AS DATE) AS first FROM events GROUP BY 1) t WHERE d >= first""",
)
def record_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records to one row per date and map entry."""
    document = department_document(spark, sf_dir)
    entries = explode_records(document, "confirmados", "fecha", "dep", "event_type", "Count")
    return entries.select(F.col("fecha").alias("date"), "event_type", "Count")


# --- benchmarks -----------------------------------------------------------------------


def mean_value(amount: str = "amount", n: str = "n") -> Column:
    return ratio(amount, n)


@register(
    "G8 P6",
    f"""WITH {NATION_YEARS_SQL},
base AS (SELECT year, amount FROM ny WHERE n_name = 'NATION_3')
SELECT ny.year, ny.n_name, CAST(ny.amount AS DOUBLE) AS amount,
       CAST(ny.amount AS DOUBLE) / nullif(CAST(base.amount AS DOUBLE), 0) AS relative
FROM ny LEFT JOIN base USING (year) WHERE ny.n_name <> 'NATION_3'""",
)
def ratio_to_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly order value of each nation relative to a base nation."""
    panel = nation_years(spark, sf_dir).select(
        "n_name", "year", "amount"
    )
    return ratio_to_base(panel, "n_name", "year", "amount", "NATION_3", "relative")


@register(
    "J2 J3 A5 A6 F4 F8",
    f"""WITH {NATION_YEARS_SQL},
sel AS (
  SELECT year, n, CASE WHEN amount / n < 270000 THEN CAST(amount AS DOUBLE) / n END AS x
  FROM ny WHERE year >= 1996 AND n_name IN {AMERICA_SQL}),
pop AS (SELECT year, sum(n) AS total FROM sel GROUP BY year)
SELECT year, round(coalesce(sum(CAST(n AS DOUBLE) / total * x), 0), 4) AS mean_value
FROM sel JOIN pop USING (year) GROUP BY year""",
)
def region_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order value of a region, weighted by orders, with some values missing."""
    recent = nation_years(spark, sf_dir, first_year=1996)
    value = F.when(F.col("amount") / F.col("n") < 270000, mean_value())
    rows = keep_members(recent, american_nations(spark, sf_dir), "n_name")
    mean = weighted_by_population(
        rows.withColumn("mean_value", value), "year", "mean_value", "n"
    )
    return mean.withColumn("mean_value", F.round("mean_value", 4))


@register(
    "J2 J3 A5",
    f"""WITH {NATION_YEARS_SQL}
SELECT n_name, year, n, CAST(sum(n) OVER (PARTITION BY year) AS BIGINT) AS region_n
FROM ny WHERE n_name IN {AMERICA_SQL}""",
)
def group_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each nation of a region beside the region's yearly total."""
    rows = keep_members(
        nation_years(spark, sf_dir), american_nations(spark, sf_dir), "n_name"
    ).select("n_name", "year", "n")
    return with_group_total(rows, "year", "n", "region_n")


def brand_survey(
    spark: SparkSession, sf_dir: str, only_year: int | None = None
) -> DataFrame:
    """Line items as a survey: brand, type, year, size class; quantity and discount percent.

    Items are added up per part and year before parts are joined.
    """
    items = table(spark, sf_dir, "lineitem")
    if only_year is not None:
        next_year = F.lit(f"{only_year + 1}-01-01").cast("timestamp_ntz")
        items = from_year(items, "l_shipdate", only_year).filter(F.col("l_shipdate") < next_year)
    discounted = F.col("l_quantity") * F.col("l_discount") * 100
    per_part = items.groupBy("l_partkey", F.year("l_shipdate").alias("year")).agg(
        F.sum(hundredths("l_quantity")).alias("pop"),
        F.sum(hundredths(discounted)).alias("hits"),
    )
    low = (F.floor((F.col("p_size") - 1) / 5) * 5 + 20).cast("int")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", low.alias("agefrom"))
    return (
        per_part.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_brand", "p_type", "year", "agefrom")
        .agg(F.sum("pop").alias("pop"), F.sum("hits").alias("hits"))
        .select(
            F.col("p_brand").alias("country"),
            F.col("p_type").alias("region_code"),
            "year",
            "agefrom",
            (F.col("agefrom") + 4).alias("ageto"),
            (ratio(F.col("hits") / 10000, F.col("pop") / 100) * 100).alias("lhc"),
            (F.col("pop") / 100).alias("pop"),
        )
    )


SURVEY_SQL = """
survey AS (
  SELECT p_brand AS country, p_type AS region_code, CAST(year(l_shipdate) AS INTEGER) AS year,
         CAST(floor((p_size - 1) / 5) * 5 + 20 AS INTEGER) AS agefrom,
         CAST(floor((p_size - 1) / 5) * 5 + 24 AS INTEGER) AS ageto,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS pop,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS hits
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4, 5)"""

SIZE_BANDS = {"25-34": [(25, 29), (30, 34)], "55-64": [(55, 59), (60, 64)]}


@register(
    "A2 A7 W5 W6 F9 C5 P6",
    f"""WITH {SURVEY_SQL},
seg AS (
  SELECT country, CASE WHEN agefrom IN (25, 30) THEN '25-34' ELSE '55-64' END AS band,
         sum(pop) AS pop, sum(hits) AS hits
  FROM survey WHERE agefrom IN (25, 30, 55, 60) GROUP BY 1, 2),
shares AS (SELECT band, pop / sum(pop) OVER (PARTITION BY band) AS share, hits / pop AS rate FROM seg)
SELECT band, round(sum(share * rate) * 100, 6) AS percent FROM shares GROUP BY band""",
)
def two_level_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discount rate per size band: brands weighted by their share of the band's quantity."""
    survey = brand_survey(spark, sf_dir)
    bands = SIZE_BANDS["25-34"] + SIZE_BANDS["55-64"]
    rows = survey.filter(within_any_band("agefrom", "ageto", bands)).withColumn(
        "band", band_of("agefrom", "ageto", SIZE_BANDS["25-34"], "25-34", "55-64")
    )
    segments = segment_rates(rows, ["country", "band"], "pop", "lhc", "rate")
    mean = weighted_rate(segments, ["band"], "pop", "rate", "percent")
    return mean.withColumn("percent", F.round("percent", 6))


@register(
    "W5 W6",
    """WITH seg AS (
  SELECT p_brand, p_size, sum(CAST(l_quantity AS DECIMAL(18,2))) AS quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT p_brand, p_size, CAST(quantity AS DOUBLE) AS quantity,
       CAST(quantity AS DOUBLE) / CAST(sum(quantity) OVER (PARTITION BY p_size) AS DOUBLE) AS share
FROM seg""",
)
def share_of_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's share of the quantity sold per size."""
    per_part = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(F.sum(hundredths("l_quantity")).alias("quantity"))
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    segments = (
        per_part.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_brand", "p_size")
        .agg(F.sum("quantity").alias("quantity"))
    )
    shares = share_of_total(segments, "p_size", "quantity", "share")
    return shares.select(
        "p_brand", "p_size", (F.col("quantity") / 100).alias("quantity"), "share"
    )


# --- whole panels ---------------------------------------------------------------------

CODES = {"NATION_0": "BOL", "NATION_1": "USA", "NATION_2": "KOR", "NATION_6": "VEN"}


def score_rows(
    spark: SparkSession, sf_dir: str, first_year: int | None = None
) -> DataFrame:
    """Nations as a score panel: Entity, Code, Year, mean order value, orders."""
    return nation_years(spark, sf_dir, first_year).select(
        F.col("n_name").alias("Entity"),
        recode("n_name", CODES).alias("Code"),
        F.col("year").alias("Year"),
        mean_value().alias("Index"),
        F.col("n").cast("double").alias("Score"),
    )


def american_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = american_nations(spark, sf_dir)
    return names.select(recode("n_name", CODES).alias("Code"))


_SCORES_SQL = f"""{NATION_YEARS_SQL},
scores AS (
  SELECT n_name AS entity,
         CASE n_name WHEN 'NATION_0' THEN 'BOL' WHEN 'NATION_1' THEN 'USA' WHEN 'NATION_2' THEN 'KOR'
              WHEN 'NATION_6' THEN 'VEN' ELSE n_name END AS code,
         year, CAST(amount AS DOUBLE) / n AS idx, CAST(n AS DOUBLE) AS score,
         n_name IN {AMERICA_SQL} AS american
  FROM ny)"""

_LABEL_SQL = """CASE {c} WHEN 'BOL' THEN 'Bolivia' WHEN 'KOR' THEN 'Corea del Sur' WHEN 'USA' THEN 'EEUU' END"""
_CLASS_SQL = """CASE WHEN "Region" = 'Bolivia' THEN 'Bolivia'
            WHEN "Region" IN ('LATAM', 'Mundo') THEN 'Benchmark Regiones'
            ELSE 'Benchmark Paises' END"""
_ORD_SQL = """CAST(list_position({levels}, {c}) AS BIGINT)"""
_LEVELS = "['Bolivia', 'Corea del Sur', 'EEUU', 'LATAM', 'Mundo']"
_CLASSES = "['Bolivia', 'Benchmark Paises', 'Benchmark Regiones']"


def _classed_sql(rows: str, columns: str, class_name: str, levels: str = _LEVELS) -> str:
    return f"""SELECT "Region", {columns}, cls AS "{class_name}",
       {_ORD_SQL.format(levels=levels, c='"Region"')} AS "Region_ord",
       {_ORD_SQL.format(levels=_CLASSES, c="cls")} AS "{class_name}_ord"
FROM (SELECT *, {_CLASS_SQL} AS cls FROM {rows})"""


@register(
    "A3 U2 J3 C3 C4 O3 G9 F3",
    f"""WITH {_SCORES_SQL},
panel AS (
  SELECT {_LABEL_SQL.format(c="code")} AS "Region", year, idx FROM scores
  WHERE code IN ('BOL', 'USA', 'KOR')
  UNION ALL SELECT 'LATAM', year, avg(idx) FROM scores WHERE american GROUP BY year
  UNION ALL SELECT 'Mundo', year, avg(idx) FROM scores GROUP BY year)
{_classed_sql("panel", 'year AS "Año", round(idx, 4) AS "Indice"', "RegionTipo")}""",
)
def satisfaction_panel_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order value per year: three nations, a region's mean and the overall mean."""
    scores = score_rows(spark, sf_dir).drop("Score")
    panel = satisfaction_panel(scores, american_codes(spark, sf_dir))
    return panel.withColumn("Indice", F.round("Indice", 4))


@register(
    "A4 J4 U3 U1 N3",
    f"""WITH {_SCORES_SQL}
SELECT year AS "Year", round_even(sum(score) / count(*), 0) AS "Score", 'LATAM' AS "Entity"
FROM scores WHERE american AND code NOT IN ('VEN') GROUP BY year""",
)
def mean_rounded_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded mean of a region's nations without one excluded code."""
    codes = members(american_codes(spark, sf_dir), "Code", F.lit(True), exclude=["VEN"])
    rows = keep_members(score_rows(spark, sf_dir), codes, "Code")
    return group_mean(rows, "Year", "Score", "Entity", "LATAM", digits=0)


_REGIME_RULES = [("nation_2$", "Corea del Sur"), ("nation_1$", "EEUU"), ("nation_0$", "Bolivia")]


@register(
    "A4 J4 U1 U3 F5 C3 C4 O3 G9 D10 D11 P1 P3 P5",
    f"""WITH {_SCORES_SQL},
panel AS (
  SELECT {_LABEL_SQL.format(c="code")} AS "Region", year, score FROM scores
  WHERE code IN ('BOL', 'USA', 'KOR')
  UNION ALL SELECT 'Mundo', year, round_even(sum(score) / count(*), 0) FROM scores GROUP BY year
  UNION ALL SELECT 'LATAM', year, round_even(sum(score) / count(*), 0) FROM scores
  WHERE american AND code <> 'VEN' GROUP BY year)
{_classed_sql("panel", 'year AS "Año", score AS "Puntuacion"', "RegionType")}""",
)
def regime_panel_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per year: three nations, the overall mean, a region's mean without one code."""
    scores = score_rows(spark, sf_dir).drop("Index")
    return regime_panel(scores, american_codes(spark, sf_dir), rules=_REGIME_RULES)


@register(
    "J2 J3 A5 A6 F8 P6 R2 R3 U1 C4 O3 G8",
    f"""WITH {_SCORES_SQL},
recent AS (
  SELECT code, year, american, score AS pop, CASE WHEN idx < 270000 THEN idx END AS x
  FROM scores WHERE year >= 1996),
region AS (
  SELECT year, coalesce(sum(pop * x), 0) / sum(pop) AS x FROM recent WHERE american GROUP BY year),
wide AS (
  SELECT year, max(x) FILTER (WHERE code = 'BOL') AS bol, max(x) FILTER (WHERE code = 'KOR') AS kor,
         max(x) FILTER (WHERE code = 'USA') AS usa, max(x) FILTER (WHERE code = 'LATAM') AS latam
  FROM (SELECT code, year, x FROM recent WHERE code IN ('BOL', 'KOR', 'USA')
        UNION ALL SELECT 'LATAM', year, x FROM region) GROUP BY year),
panel AS (
  SELECT 'Bolivia' AS "Region", year, bol / usa AS v FROM wide
  UNION ALL SELECT 'Corea del Sur', year, kor / usa FROM wide
  UNION ALL SELECT 'LATAM', year, latam / usa FROM wide)
{_classed_sql("panel", 'year AS "Año", round(v, 8) AS value, ' + decimals_sql("(v * 100)", 2) + ' AS percent', "RegionTipo", "['Bolivia', 'Corea del Sur', 'LATAM']")}""",
)
def gdp_panel_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order value relative to one nation, with some values missing."""
    value = F.when(F.col("Index") < 270000, F.col("Index"))
    series = score_rows(spark, sf_dir, first_year=1996).select(
        F.col("Code").alias("countrycode"),
        F.col("Year").alias("year"),
        value.alias("cgdppc"),
        F.col("Score").alias("pop"),
    )
    panel = gdp_panel(series, american_codes(spark, sf_dir), first_year=1996)
    return panel.withColumn("value", F.round("value", 8))


_BRAND_RULES = [("brand#11$", "Corea del Sur"), ("brand#12$", "EEUU"), ("brand#13$", "Bolivia")]


@register(
    "S8 A2 A7 C3 C5 F5 F9 P1 P3 P5 W5 W6 U1 O3 G9 F12",
    f"""WITH {SURVEY_SQL},
r AS (
  SELECT *, CASE WHEN agefrom IN (25, 30) THEN '25-34' ELSE '55-64' END AS band
  FROM survey WHERE year = 2000 AND agefrom IN (25, 30, 55, 60)),
brands AS (
  SELECT country, CASE country WHEN 'Brand#11' THEN 'Corea del Sur' WHEN 'Brand#12' THEN 'EEUU'
                       ELSE 'Bolivia' END AS "Region", band, sum(hits) / sum(pop) * 100 AS p
  FROM r WHERE country IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY 1, 2, 3),
panel AS (
  SELECT "Region", band, p FROM brands
  UNION ALL SELECT 'LATAM', band, sum(hits) / sum(pop) * 100 FROM r
  WHERE region_code IN ('PROMO', 'ECONOMY') GROUP BY band
  UNION ALL SELECT 'Mundo', band, sum(hits) / sum(pop) * 100 FROM r GROUP BY band)
SELECT "Region", band AS "Edad", r AS "Porc.Completado.Edu.Terciaria", CASE WHEN r BETWEEN 0 AND 5 THEN r END AS drawn,
       CAST(list_position(['Mundo', 'LATAM', 'Bolivia', 'EEUU', 'Corea del Sur'], "Region") AS BIGINT)
         AS "Region_ord"
FROM (SELECT *, {decimals_sql("p", 3)} AS r FROM panel)""",
)
def education_panel_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discount rates by size band: three brands, a group of types and all items."""
    return education_panel(
        brand_survey(spark, sf_dir, only_year=2000),
        year=2000,
        rules=_BRAND_RULES,
        region_pattern="promo|economy",
        digits=3,
        limits=(0, 5),
    )


VACCINATION_NAMES = {
    "NATION_0": "Bolivia (Plurinational State of)",
    "NATION_1": "Republic of Korea",
    "NATION_2": "Democratic People's Republic of Korea",
    "NATION_3": "United States of America",
}
REGION_NAMES = {"AMERICA": "Americas", "ASIA": "South-East Asia", "EUROPE": "Europe"}


def wide_vaccination(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders per year in the layout of the coverage tables: by country and by region."""
    names = year_names(spark, sf_dir)
    countries = wide_years(spark, sf_dir).withColumnRenamed("Region", "Country")
    countries = countries.withColumn("Country", recode("Country", VACCINATION_NAMES))
    regions = table(spark, sf_dir, "region")
    rows = (
        nation_years(spark, sf_dir)
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            recode("r_name", REGION_NAMES).alias("WHO region"),
            F.col("year").cast("string").alias("year"),
            "n",
        )
    )
    levels = with_total_level(rows, "WHO region", ["year"], "n", "(WHO) Global")
    wide = spread(
        levels.withColumn("n", F.col("n").cast("int")), ["WHO region"], "year", names, "n"
    )
    return countries, wide.toDF("WHO region", *[f" {y}" for y in names])


VACCINATION_SQL = f"""WITH {NATION_YEARS_SQL},
ry AS (SELECT r_name, year, sum(n) AS n FROM ny JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
v AS (
  SELECT CASE n_name WHEN 'NATION_0' THEN 'Bolivia' WHEN 'NATION_1' THEN 'Corea del Sur'
              ELSE 'EEUU' END AS "Region", year, n
  FROM ny WHERE n_name IN ('NATION_0', 'NATION_1', 'NATION_3')
  UNION ALL SELECT 'Americas', year, n FROM ry WHERE r_name = 'AMERICA'
  UNION ALL SELECT 'Mundo', year, sum(n) FROM ry GROUP BY year),
grid AS (SELECT r."Region", y.year FROM (SELECT DISTINCT "Region" FROM v) r,
                (SELECT DISTINCT year FROM ny) y)
SELECT g."Region", g.year AS "Año", CAST(v.n AS INTEGER) AS value,
       CASE WHEN g.year BETWEEN 1980 AND 2020 THEN g.year END AS drawn,
       CASE WHEN g."Region" = 'Bolivia' THEN 'Bolivia'
            WHEN g."Region" IN ('Americas', 'Mundo') THEN 'Benchmark Regiones'
            ELSE 'Benchmark Paises' END AS "RegionType",
       CAST(list_position(['Bolivia', 'Corea del Sur', 'EEUU', 'Americas', 'Mundo'], g."Region") AS BIGINT)
         AS "Region_ord",
       CAST(CASE WHEN g."Region" = 'Bolivia' THEN 1 WHEN g."Region" IN ('Americas', 'Mundo') THEN 3
                 ELSE 2 END AS BIGINT) AS "RegionType_ord"
FROM grid g LEFT JOIN v USING ("Region", year)"""


@register("F5 C3 C4 R2 D10 D11 D12 U1 O3 G9 P3", VACCINATION_SQL)
def vaccination_panel_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two wide yearly tables to one classed panel."""
    return vaccination_panel(*wide_vaccination(spark, sf_dir))


@register(
    "F11 A8 D9",
    f"""WITH {NATION_YEARS_SQL}
SELECT n_name, year, CAST(amount AS DOUBLE) / n AS mean_value,
       round_even(CAST(amount AS DOUBLE) / n, 0) AS label
FROM ny WHERE year = (SELECT max(year) FROM ny)""",
)
def newest_year_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' rounded mean order values in the newest year."""
    panel = nation_years(spark, sf_dir).select("n_name", "year", mean_value().alias("mean_value"))
    return newest_labels(panel, "year", "mean_value", 0)


INDEX_NAMES = {
    "NATION_0": "Bolivia",
    "NATION_1": "Corea del Sur",
    "NATION_2": "EEUU",
    "NATION_3": "Italia",
    "NATION_5": "Brasil",
    "NATION_6": "Ecuador",
}
#: The names of the index itself, which the overlay matches and prints.
EXPORT_NAMES = INDEX_NAMES | {
    "NATION_1": "South Korea",
    "NATION_2": "United States",
    "NATION_3": "Italy",
    "NATION_5": "Brazil",
}


def case_sql(value: str, names: dict[str, str]) -> str:
    return f"CASE {value} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())} ELSE {value} END"


# --- joins ----------------------------------------------------------------------------


@register(
    "J1",
    """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS errors FROM events
           WHERE event_type = 'error' GROUP BY 1, 2),
s AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS signups FROM events
      WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT user_id, CAST(d AS VARCHAR) AS date, errors, signups FROM e JOIN s USING (user_id, d)""",
)
def inner_join_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' errors and signups on the days that have both."""
    events = table(spark, sf_dir, "events")

    def daily(kind: str, to: str) -> DataFrame:
        return (
            events.filter(F.col("event_type") == kind)
            .groupBy("user_id", F.to_date("ts").alias("date"))
            .agg(F.count(F.lit(1)).alias(to))
        )

    joined = daily("error", "errors").join(daily("signup", "signups"), ["user_id", "date"])
    return joined.withColumn("date", iso("date"))


@register(
    "J1 G10",
    f"""WITH {places_sql(None, "cases", 1, {"Korea, South": "South Korea", "US": "United States"})},
idx AS (
  SELECT {{case}} AS country, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT country AS "Country", count(*) FILTER (cases.q IS NOT NULL AND idx.q IS NOT NULL) AS matched,
       count(*) FILTER (idx.q IS NULL) AS only_left, count(*) FILTER (cases.q IS NULL) AS only_right
FROM cases FULL JOIN idx USING (country, q) GROUP BY country""".replace("{case}", case_sql("n_name", INDEX_NAMES)),
)
def overlay_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the overlay's join keeps and loses on either side, by country; some names differ."""
    curves = country_curves(wide_case_series(spark, sf_dir), 1, SERIES_NAMES, keep_date=True)
    return match_losses(curves, index_rows(spark, sf_dir), ["Country", "Date"], "Country")


OVERLAY_SHOWN = ["Corea del Sur", "Italia", "EEUU", "Bolivia", "Brasil", "Ecuador"]
OVERLAY_PRINTED = {"EEUU": "Estados Unidos", "Brasil": "Brazil"}


@register(
    "G10 J1 C1 D8 F10 F12 O3 P6 N4",
    f"""WITH {PLACES_SQL},
idx AS (
  SELECT CASE n_name WHEN 'NATION_0' THEN 'Bolivia' WHEN 'NATION_1' THEN 'Corea del Sur'
              WHEN 'NATION_2' THEN 'EEUU' WHEN 'NATION_3' THEN 'Italia' WHEN 'NATION_5' THEN 'Brasil'
              WHEN 'NATION_6' THEN 'Ecuador' ELSE n_name END AS country,
         CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q,
         count(*) FILTER (WHERE o_orderpriority = '1-URGENT') * 100 / count(*) AS urgent,
         CAST(count(*) FILTER (WHERE o_orderstatus = 'P' AND o_totalprice > 450000) AS DOUBLE) AS cases
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2)
SELECT CASE country WHEN 'EEUU' THEN 'Estados Unidos' WHEN 'Brasil' THEN 'Brazil' ELSE country END
         AS "Country", CAST(q AS VARCHAR) AS date, rn AS "Day", cases AS "ConfirmedCases",
       round(CASE WHEN cases BETWEEN 10 AND 100000 THEN log10(cases) END, 6) AS count_drawn,
       CASE WHEN cases > 0 THEN round(log10(cases), 6) ELSE CAST('-inf' AS DOUBLE) END AS count_log10,
       round(CASE WHEN urgent * 0.05 BETWEEN 1 AND 5 THEN urgent * 0.05 END, 6) AS index_drawn,
       CASE WHEN rn BETWEEN 0 AND 100 THEN rn END AS day_drawn,
       CAST(list_position(['Corea del Sur', 'Italia', 'EEUU', 'Bolivia', 'Brasil', 'Ecuador'], country)
            AS BIGINT) AS "Country_ord"
FROM aligned JOIN idx USING (country, q)
WHERE country IN ('Corea del Sur', 'Italia', 'EEUU', 'Bolivia', 'Brasil', 'Ecuador')""",
)
def stringency_overlay_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case curves joined to an index of the same nation and quarter, both on one axis."""
    curves = country_curves(wide_case_series(spark, sf_dir), keep_date=True)
    drawn = joined_overlay(curves, index_rows(spark, sf_dir), OVERLAY_SHOWN, OVERLAY_PRINTED)
    return drawn.select(
        "Country",
        F.col("Date").cast("string").alias("date"),
        "Day",
        "ConfirmedCases",
        F.round("count_drawn", 6).alias("count_drawn"),
        F.when(F.col("ConfirmedCases") == 0, F.col("count_log10"))
        .otherwise(F.round("count_log10", 6))
        .alias("count_log10"),
        F.round("index_drawn", 6).alias("index_drawn"),
        "day_drawn",
        "Country_ord",
    )


@register(
    "G10 J1 C1 D8 F10 F12 O3 P6 F6 G5",
    f"""WITH {places_sql(None, "cases", 1, {"Korea, South": "South Korea", "US": "United States"})},
idx AS (
  SELECT {case_sql("n_name", EXPORT_NAMES)} AS country, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q,
         count(*) FILTER (WHERE o_orderpriority = '1-URGENT') * 100 / count(*) AS urgent,
         CAST(count(*) FILTER (WHERE o_orderstatus = 'P' AND o_totalprice > 450000) AS DOUBLE) AS large
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2)
SELECT {case_sql("country", PRINTED_NAMES)} AS "Country", CAST(q AS VARCHAR) AS date, cnt AS "Count", rn AS "Day",
       nd AS "NumDays", large AS "ConfirmedCases",
       round(CASE WHEN large BETWEEN 10 AND 100000 THEN log10(large) END, 6) AS count_drawn,
       round(CASE WHEN urgent * 0.05 BETWEEN 1 AND 5 THEN urgent * 0.05 END, 6) AS index_drawn,
       CASE WHEN rn BETWEEN 0 AND 100 THEN rn END AS day_drawn,
       CAST(list_position([{", ".join(f"'{n}'" for n in SHOWN)}], country) AS BIGINT) AS "Country_ord"
FROM cases JOIN idx USING (country, q) WHERE country IN ({", ".join(f"'{n}'" for n in SHOWN)})""",
)
def stringency_overlay_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlay as it stands: cases since the first one, under the names that series and index have."""
    drawn = stringency_overlay(wide_case_series(spark, sf_dir), index_rows(spark, sf_dir, EXPORT_NAMES))
    return drawn.select(
        "Country", iso("Date").alias("date"), "Count", "Day", "NumDays", "ConfirmedCases",
        F.round("count_drawn", 6).alias("count_drawn"), F.round("index_drawn", 6).alias("index_drawn"),
        "day_drawn", "Country_ord",
    )


def index_rows(spark: SparkSession, sf_dir: str, names: dict[str, str] = INDEX_NAMES) -> DataFrame:
    """Per nation and quarter: percentage of urgent orders and number of large pending ones."""
    urgent = F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1))
    large = F.count(F.when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 450000), 1))
    per_customer = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", quarter_start("o_orderdate").alias("Date"))
        .agg(F.count(F.lit(1)).alias("n"), urgent.alias("urgent"), large.alias("large"))
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "Date")
        .agg(F.sum("n").alias("n"), F.sum("urgent").alias("urgent"), F.sum("large").alias("large"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            recode("n_name", names).alias("Country"),
            "Date",
            ratio(F.col("urgent") * 100, "n").alias("StringencyIndex"),
            F.col("large").cast("double").alias("ConfirmedCases"),
        )
    )


# --- missing values -------------------------------------------------------------------


@register(
    "N1 N2 A3 A5",
    """WITH v AS (
  SELECT user_id, CASE WHEN value <= 100 THEN CAST(value AS DECIMAL(18,2)) END AS x FROM events)
SELECT user_id, CAST(CASE WHEN count(x) = count(*) THEN sum(x) END AS DOUBLE) AS strict_total,
       CASE WHEN count(x) = count(*) THEN CAST(sum(x) AS DOUBLE) / count(x) END AS strict_average,
       CAST(coalesce(sum(x), 0) AS DOUBLE) AS present_total
FROM v GROUP BY user_id""",
)
def strict_null_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and means per user where values above 100 count as missing."""


    value = F.when(F.col("value") <= 100, F.col("value").cast(MONEY))
    rows = table(spark, sf_dir, "events").select("user_id", value.alias("x"))
    return rows.groupBy("user_id").agg(
        strict_sum("x").cast("double").alias("strict_total"),
        strict_mean("x").alias("strict_average"),
        sum_or_zero("x").cast("double").alias("present_total"),
    )


@register(
    "C4 O3 U2",
    f"""WITH {NATION_YEARS_SQL},
p AS (SELECT n_name AS entity, year, n AS orders, 'nation' AS kind FROM ny
      UNION ALL SELECT r_name, NULL, NULL, NULL FROM region)
SELECT entity, year, orders, kind,
       CASE WHEN entity = 'NATION_0' THEN 'NATION_0' WHEN entity IN ('AMERICA', 'ASIA')
            THEN 'Benchmark Regiones' ELSE 'Benchmark Paises' END AS class,
       CAST(list_position(['NATION_0', 'AMERICA'], entity) AS BIGINT) AS entity_ord
FROM p""",
)
def classed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacked rows with different columns, classed and ordered."""
    nations = nation_years(spark, sf_dir).select(
        F.col("n_name").alias("entity"), "year", F.col("n").alias("orders"), F.lit("nation").alias("kind")
    )
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("entity"))
    return (
        bind_rows(nations, regions, fill=True)
        .withColumn("class", benchmark_class("entity", "NATION_0", ["AMERICA", "ASIA"]))
        .withColumn("entity_ord", level_rank("entity", ["NATION_0", "AMERICA"]))
    )
