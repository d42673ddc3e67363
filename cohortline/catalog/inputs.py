"""Stand-ins for the library's inputs, derived from the driver's tables.

Orders and events are added up per key and date before they are joined to a dimension,
so a customer or product with a large part of all rows brings at most one row per date
to the join.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.catalog.scope import once
from cohortline.functions import column, recode
from cohortline.operators.cohort import align_runs, align_since_threshold
from cohortline.operators.latest import latest_of_series
from cohortline.operators.reshape import spread
from cohortline.operators.series import carry_forward, count_by_date, running_total

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return once(path, lambda: spark.read.parquet(path))


def iso(col: str) -> Column:
    """Date as ISO text."""
    return F.col(col).cast("string").alias(col)


def hundredths(amount: str | Column) -> Column:
    """An amount with two decimals as a whole number of hundredths.

    Whole numbers add up exactly in any order, and much faster than wide decimals.
    """
    return F.rint(column(amount) * 100).cast("bigint")


def quarter_start(col: str) -> Column:
    return F.trunc(F.to_date(col), "quarter")


# --- events ---------------------------------------------------------------------------


def event_totals(
    spark: SparkSession, sf_dir: str, entity: str, least_value: float | None = None
) -> tuple[DataFrame, Column]:
    """Cumulative events per entity on the days that have any, and the last day of all.

    With ``least_value`` only events of that value or more are counted, on all days that have any event.
    """
    wanted = None if least_value is None else F.col("value") >= least_value
    daily = count_by_date(table(spark, sf_dir, "events"), entity, F.to_date("ts"), "date", "Count", wanted)
    return running_total(daily, entity, "date", "Count"), latest_of_series(daily, "date", "Count")


def event_series(
    spark: SparkSession, sf_dir: str, entity: str, least_value: float | None = None
) -> DataFrame:
    """Cumulative events per entity on every calendar day since its first event."""
    totals, last_day = event_totals(spark, sf_dir, entity, least_value)
    return carry_forward(totals, entity, "date", last_day)


def event_cohort(
    spark: SparkSession, sf_dir: str, entity: str, threshold: int = 10
) -> DataFrame:
    """The series aligned on the threshold, a row per day."""
    series = event_series(spark, sf_dir, entity)
    return align_since_threshold(series, entity, "date", "Count", threshold)


def event_runs(spark: SparkSession, sf_dir: str, entity: str, threshold: int = 10) -> DataFrame:
    """The cohort with a row per run of equal days, for results that need no row per day."""
    totals, last_day = event_totals(spark, sf_dir, entity)
    return align_runs(totals, entity, "date", "Count", threshold, last_day)


def event_cohort_sql(entity: str, threshold: int = 10) -> str:
    """Common table expressions ending in ``coh``, filled by a join with a calendar."""
    return f"""
daily AS (
  SELECT {entity}, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2),
cal AS (
  SELECT {entity}, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d
  FROM (SELECT {entity}, min(d) AS lo, (SELECT max(d) FROM daily) AS hi FROM daily GROUP BY 1)),
cum AS (
  SELECT c.{entity}, c.d,
         CAST(sum(coalesce(n, 0)) OVER (PARTITION BY c.{entity} ORDER BY c.d) AS BIGINT) AS cnt
  FROM cal c LEFT JOIN daily x ON x.{entity} = c.{entity} AND x.d = c.d),
coh AS (
  SELECT {entity}, d, cnt,
         CAST(row_number() OVER (PARTITION BY {entity} ORDER BY d) AS INTEGER) AS rn,
         CAST(count(*) OVER (PARTITION BY {entity}) AS INTEGER) AS nd
  FROM cum WHERE cnt >= {threshold})"""


# --- orders ---------------------------------------------------------------------------


def from_year(df: DataFrame, date: str, year: int) -> DataFrame:
    """Rows from the first day of a year on, as a bound on the column that the scan can use."""
    return df.filter(F.col(date) >= F.lit(f"{year}-01-01").cast("timestamp_ntz"))


def orders_by_place(
    spark: SparkSession,
    sf_dir: str,
    period: Column,
    *places: str,
    first_year: int | None = None,
    status: str | None = None,
) -> DataFrame:
    """Orders ``n`` and their value in ``cents`` per period, nation and customer columns.

    With a status, orders of others do not count, but a place that has no other orders stays, with 0.
    """
    orders = table(spark, sf_dir, "orders")
    counted = F.lit(1) if status is None else F.when(F.col("o_orderstatus") == status, 1)
    if first_year is not None:
        orders = from_year(orders, "o_orderdate", first_year)
    per_customer = orders.groupBy("o_custkey", period.alias("period")).agg(
        F.count(counted).alias("n"), F.coalesce(F.sum(hundredths("o_totalprice") * counted), F.lit(0)).alias("cents")
    )
    customer_columns = [c for c in places if c.startswith("c_")]
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", *customer_columns
    )
    keys = ["c_nationkey", *customer_columns, "period"]
    placed = (
        per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(*keys)
        .agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))
    )
    nations = table(spark, sf_dir, "nation")
    return placed.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "n_name", "n_regionkey", *customer_columns, "period", "n", "cents"
    )


def nation_years(
    spark: SparkSession, sf_dir: str, first_year: int | None = None
) -> DataFrame:
    """Per nation and year: orders ``n``, value ``amount``."""
    years = orders_by_place(spark, sf_dir, F.year("o_orderdate"), first_year=first_year)
    return years.select(
        "n_name",
        "n_regionkey",
        F.col("period").alias("year"),
        "n",
        (F.col("cents") / 100).alias("amount"),
    )


NATION_YEARS_SQL = """
ny AS (
  SELECT n_name, n_regionkey, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amount
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2, 3)"""


def nation_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation and quarter: orders ``Count``."""
    quarters = orders_by_place(spark, sf_dir, quarter_start("o_orderdate"))
    return quarters.select("n_name", F.col("period").alias("date"), F.col("n").alias("Count"))


NATION_QUARTERS_SQL = """
nq AS (
  SELECT n_name, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS d, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2)"""


def nation_cohort(spark: SparkSession, sf_dir: str, threshold: int = 10) -> DataFrame:
    """Cumulative orders per nation and quarter, aligned on the threshold."""
    series = running_total(nation_quarters(spark, sf_dir), "n_name", "date", "Count")
    return align_since_threshold(series, "n_name", "date", "Count", threshold)


NATION_COHORT_SQL = f"""{NATION_QUARTERS_SQL},
ncum AS (
  SELECT n_name, d, CAST(sum(n) OVER (PARTITION BY n_name ORDER BY d) AS BIGINT) AS cnt FROM nq),
ncoh AS (
  SELECT n_name, d, cnt, CAST(row_number() OVER (PARTITION BY n_name ORDER BY d) AS INTEGER) AS rn,
         CAST(count(*) OVER (PARTITION BY n_name) AS INTEGER) AS nd
  FROM ncum WHERE cnt >= 10)"""


# --- wide case series -----------------------------------------------------------------

# Nations take the names that the tracker recodes, so that its own defaults apply.
SERIES_COUNTRIES = {
    "NATION_0": "Bolivia",
    "NATION_1": "Korea, South",
    "NATION_2": "US",
    "NATION_3": "Italy",
    "NATION_4": "Spain",
    "NATION_5": "Brazil",
    "NATION_6": "Ecuador",
    "NATION_7": "China",
}
SERIES_PROVINCES = {"BUILDING": "Hong Kong"}


def order_span(spark: SparkSession, sf_dir: str) -> tuple[date, date]:
    """First and last order date; the header of a wide table is known before it is planned."""
    dates = table(spark, sf_dir, "orders").agg(
        F.to_date(F.min("o_orderdate")), F.to_date(F.max("o_orderdate"))
    )
    first, last = once(("span", sf_dir), dates.first)
    return first, last


def quarter_headers(spark: SparkSession, sf_dir: str) -> list[str]:
    """``m/d/yy`` names of all quarters in the orders."""
    first, last = order_span(spark, sf_dir)
    start, end = (d.year * 4 + (d.month - 1) // 3 for d in (first, last))
    return [f"{q % 4 * 3 + 1}/1/{q // 4 % 100:02d}" for q in range(start, end + 1)]


def wide_case_series(
    spark: SparkSession, sf_dir: str, status: str | None = None
) -> DataFrame:
    """Cumulative orders in the layout of a case series: a row per place, a column per quarter.

    Places are nation and market segment; the segment BUILDING of the nation China plays the
    promoted province. Orders of one status play the deaths.
    """
    headers = quarter_headers(spark, sf_dir)
    place = ["n_name", "c_mktsegment"]
    placed = orders_by_place(spark, sf_dir, quarter_start("o_orderdate"), *place, status=status)
    series = placed.select(*place, F.col("period").alias("date"), F.col("n").alias("Count"))
    cumulative = running_total(series, place, "date", "Count")
    last_quarter = F.trunc(F.lit(order_span(spark, sf_dir)[1]), "quarter")
    filled = carry_forward(cumulative, place, "date", last_quarter, months=3)
    named = filled.select(
        *place,
        F.date_format("date", "M/d/yy").alias("header"),
        F.col("Count").cast("double").alias("Count"),
    )
    wide = spread(named, place, "header", headers, "Count")
    country = recode("n_name", SERIES_COUNTRIES)
    province = F.when(country == "China", recode("c_mktsegment", SERIES_PROVINCES)).otherwise(
        F.col("c_mktsegment")
    )
    return wide.select(
        province.alias("Province/State"),
        country.alias("Country/Region"),
        F.lit(0.0).alias("Lat"),
        F.lit(0.0).alias("Long"),
        *[F.coalesce(F.col(f"`{h}`"), F.lit(0.0)).alias(h) for h in headers],
    )
