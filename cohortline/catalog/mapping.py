"""Queries on category mapping, selection, functions, readers and writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline.catalog.cohorts import (
    PLACES_SQL,
    USER_COHORT_SQL,
    doubling_sql,
)
from cohortline.catalog.inputs import (
    NATION_YEARS_SQL,
    event_cohort,
    event_runs,
    event_series,
    hundredths,
    iso,
    nation_years,
    table,
    wide_case_series,
)
from cohortline.catalog.panels import (
    AMERICA_SQL,
    DEPARTMENTS_SQL,
    EVENT_TYPES,
    VACCINATION_SQL,
    case_sql,
    american_nations,
    department_document,
    index_rows,
    score_rows,
    wide_vaccination,
    wide_years,
)
from cohortline.catalog.registry import register
from cohortline.functions import (
    band_of,
    blank_if,
    clip_to_domain,
    column,
    day_before,
    dmy,
    fill_blank,
    first_match,
    half_even,
    level_rank,
    log10_ieee,
    parse_iso,
    parse_mdy,
    parse_yyyymmdd,
    paste,
    promote,
    ratio,
    recode,
    reversed_level_rank,
    swap,
    template,
    thousands,
    within_any_band,
)
from cohortline.operators.benchmark import keep_members, members
from cohortline.operators.doubling import doubling_table
from cohortline.operators.cohort import align_since_threshold
from cohortline.operators.latest import latest
from cohortline.operators.stacking import with_first_appearance, with_locale_rank
from cohortline.plans.panels import vaccination_panel
from cohortline.plans.tracker import (
    PLACE_COLUMNS,
    country_curves,
    department_curves,
    department_update_day,
    newest_record,
    snapshot_curves,
    update_label,
)
from cohortline.session import scratch_path
from cohortline.sources import (
    export_schema,
    melt_years,
    read_departments,
    read_series,
    read_stringency,
    read_table,
    read_titled,
    read_wide_series,
    save_bucketed,
    save_chart_table,
    save_summary_table,
)

# --- mapping --------------------------------------------------------------------------


@register(
    "F5 C3 D10 D11",
    """SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), '^small') THEN 'small'
            WHEN regexp_matches(lower(p_name), 'ring') THEN 'ring' ELSE 'bolt' END AS kind
FROM part WHERE regexp_matches(lower(p_name), '^small|ring|bolt')""",
)
def regex_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose folded name matches a pattern, labelled by the first match."""
    parts = table(spark, sf_dir, "part").filter(F.lower("p_name").rlike("^small|ring|bolt"))
    kind = first_match("p_name", [("^small", "small"), ("ring", "ring")], "bolt")
    return parts.select("p_partkey", kind.alias("kind"))


@register(
    "C1 C2 P2",
    """SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING' WHEN n_name = 'NATION_0' THEN 'Bolivia'
            WHEN n_name = 'NATION_1' THEN 'EEUU' ELSE n_name END AS entity,
       CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
)
def recode_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances per recoded nation, with one segment counted as an entity of its own."""
    balances = (
        table(spark, sf_dir, "customer")
        .groupBy("c_nationkey", "c_mktsegment")
        .agg(F.sum(hundredths("c_acctbal")).alias("cents"))
    )
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    names = {"NATION_0": "Bolivia", "NATION_1": "EEUU"}
    entity = promote("c_mktsegment", recode("n_name", names), ["BUILDING"])
    return (
        balances.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(entity.alias("entity"))
        .agg((F.sum("cents") / 100).alias("balance"))
    )


@register(
    "F9 C5",
    """SELECT p_partkey, CASE WHEN p_size IN (1, 2) THEN 'small' ELSE 'large' END AS band
FROM part WHERE p_size IN (1, 2, 49, 50)""",
)
def size_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in one of four exact size bands, labelled by two groups."""
    small, large = [(1, 2), (2, 3)], [(49, 50), (50, 51)]
    parts = table(spark, sf_dir, "part").withColumn("upper", F.col("p_size") + 1)
    kept = parts.filter(within_any_band("p_size", "upper", small + large))
    return kept.select(
        "p_partkey", band_of("p_size", "upper", small, "small", "large").alias("band")
    )


PRIORITIES = ["5-LOW", "1-URGENT", "3-MEDIUM"]


@register(
    "O3 O4 O6",
    """SELECT o_orderkey, o_orderpriority AS priority,
       CASE o_orderpriority WHEN '5-LOW' THEN 1::BIGINT WHEN '1-URGENT' THEN 2 WHEN '3-MEDIUM' THEN 3
            END AS listed,
       CASE o_orderpriority WHEN '5-LOW' THEN 3::BIGINT WHEN '1-URGENT' THEN 2 WHEN '3-MEDIUM' THEN 1
            END AS reversed,
       min(o_orderkey) OVER (PARTITION BY o_orderpriority) AS appearance
FROM orders""",
)
def category_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the rank of their priority in a list, from its end, and by first appearance."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("priority")
    )
    return with_first_appearance(orders, "priority", "o_orderkey", "appearance").select(
        "o_orderkey",
        "priority",
        level_rank("priority", PRIORITIES).alias("listed"),
        reversed_level_rank("priority", PRIORITIES).alias("reversed"),
        "appearance",
    )


@register(
    "A9",
    """SELECT DISTINCT o_orderpriority AS priority, o_orderstatus AS status FROM orders""",
)
def distinct_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combinations of priority and status that occur."""
    return (
        table(spark, sf_dir, "orders")
        .select(
            F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")
        )
        .distinct()
    )


@register(
    "C6 C7 C8 P11",
    """SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'NA') AS priority,
       CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE o_orderstatus END AS status
FROM orders""",
)
def replaced_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with one label blanked, blanks filled and one label swapped."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        fill_blank(blank_if("o_orderpriority", "5-LOW"), "NA").alias("priority"),
        swap("o_orderstatus", "P", "pending").alias("status"),
    )


# --- selection ------------------------------------------------------------------------


@register(
    "F8 F10 F12",
    """SELECT o_orderkey, o_totalprice,
       CASE WHEN o_totalprice BETWEEN 100000 AND 300000 THEN o_totalprice END AS drawn
FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2000-01-01'
  AND nullif(o_orderpriority, '5-LOW') IS NOT NULL""",
)
def ranges_and_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a date range with a priority above low, values outside the axis blanked."""
    day = F.col("o_orderdate")
    start, end = (F.lit(t).cast("timestamp_ntz") for t in ("1996-01-01", "2000-01-01"))
    kept = (
        table(spark, sf_dir, "orders")
        .filter((day >= start) & (day < end))
        .filter(blank_if("o_orderpriority", "5-LOW").isNotNull())
    )
    drawn = clip_to_domain("o_totalprice", 100000.0, 300000.0)
    return kept.select("o_orderkey", "o_totalprice", drawn.alias("drawn"))


@register(
    "F4 J3 A9 P10",
    f"""SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (
  SELECT n_nationkey FROM nation WHERE n_name IN {AMERICA_SQL})""",
)
def customers_of_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose nation is in the code set of a region."""
    nations = table(spark, sf_dir, "nation")
    codes = keep_members(nations, american_nations(spark, sf_dir), "n_name").select("n_nationkey")
    customers = table(spark, sf_dir, "customer")
    return keep_members(customers, codes, "c_nationkey").select("c_custkey", "c_name")


@register(
    "J4 U3 U4 A9",
    f"""SELECT n_name FROM nation WHERE n_name IN (
  SELECT * FROM {AMERICA_SQL} EXCEPT (VALUES ('NATION_6'), ('NATION_11')))""",
)
def region_without_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region without two of them."""
    names = american_nations(spark, sf_dir)
    return members(names, "n_name", F.lit(True), exclude=["NATION_6", "NATION_11"])


@register(
    "P1 P2 P3 P5",
    """SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, 'LATAM' AS "Region"
FROM customer""",
)
def projected_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with columns dropped, renamed and added."""
    return (
        table(spark, sf_dir, "customer")
        .drop("c_name", "c_nationkey")
        .withColumnsRenamed({"c_custkey": "id", "c_acctbal": "balance", "c_mktsegment": "segment"})
        .withColumn("Region", F.lit("LATAM"))
    )


# --- functions ------------------------------------------------------------------------


@register(
    "D1 D2 D3 D4 D5 D17",
    """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CAST(d AS VARCHAR) AS from_mdy, CAST(d AS VARCHAR) AS from_iso,
       CAST(d AS VARCHAR) AS from_number, strftime(d, '%d/%m/%y') AS short,
       strftime(d, '%d/%m/%Y') AS long, strftime(d - INTERVAL 1 DAY, '%d/%m/%y') AS before
FROM d""",
)
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates through every text form and back."""
    dates = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.to_date("o_orderdate").alias("d"),
    ).select(
        "*",
        F.date_format("d", "M/d/yy").alias("mdy"),
        F.date_format("d", "yyyy-MM-dd").alias("dashed"),
        F.date_format("d", "yyyyMMdd").cast("double").alias("number"),
    )
    return dates.select(
        "o_orderkey",
        parse_mdy("mdy").cast("string").alias("from_mdy"),
        parse_iso("dashed").cast("string").alias("from_iso"),
        parse_yyyymmdd("number").cast("string").alias("from_number"),
        dmy("d").alias("short"),
        dmy("d", long_year=True).alias("long"),
        dmy(day_before("d")).alias("before"),
    )


@register(
    "D13 D14 D15 N1",
    f"""WITH {NATION_YEARS_SQL}
SELECT n_name, year, format('{{:,}}', n) AS shown, n_name || ' ' || n || ' días' AS pasted,
       coalesce(CASE WHEN n > 80 THEN CAST(n AS VARCHAR) END, 'NA') || ' días' AS missing,
       'Fecha más reciente: ' || year || ' (' || n_name || ')' AS template
FROM ny""",
)
def format_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text labels for the yearly orders of nations."""
    return nation_years(spark, sf_dir).select(
        "n_name",
        "year",
        thousands("n").alias("shown"),
        paste("n_name", "n", F.lit("días")).alias("pasted"),
        paste(F.when(F.col("n") > 80, F.col("n")), F.lit("días")).alias("missing"),
        template("Fecha más reciente: %s (%s)", "year", "n_name").alias("template"),
    )


@register(
    "D4 D5 D14 O2 A8",
    """WITH m AS (SELECT CAST(max(o_orderdate) AS DATE) AS d FROM orders)
SELECT 'Última fecha de actualización:  ' || strftime(d, '%d/%m/%Y') AS header,
       strftime(d - INTERVAL 1 DAY, '%d/%m/%y') AS shown_day
FROM m""",
)
def update_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header text with the newest order date, and the day before it."""
    newest = table(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("newest"))
    return newest.select(
        update_label(F.to_date("newest")).alias("header"),
        department_update_day(F.to_date("newest").cast("string")).alias("shown_day"),
    )


@register(
    "D6 D7 D8 D9 N3 N4 N5 P6",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round(ln(l_extendedprice), 6) AS natural_log,
       CASE WHEN l_discount > 0 THEN round(log10(l_discount), 6) ELSE CAST('-inf' AS DOUBLE) END AS log_discount,
       CAST(ceil(log10(l_extendedprice)) AS BIGINT) AS decade, round_even(l_quantity / 2, 0) AS half,
       CASE WHEN l_tax <> 0 THEN l_quantity / l_tax WHEN l_quantity > 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END AS per_tax, pow(2.0, l_linenumber) AS doubled
FROM lineitem""",
)
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithms, powers, rounding and division on every line item."""
    log_discount = log10_ieee("l_discount")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.round(F.log("l_extendedprice"), 6).alias("natural_log"),
        F.when(F.col("l_discount") > 0, F.round(log_discount, 6))
        .otherwise(log_discount)
        .alias("log_discount"),
        F.ceil(F.log10("l_extendedprice")).alias("decade"),
        half_even(F.col("l_quantity") / 2).alias("half"),
        ratio("l_quantity", "l_tax").alias("per_tax"),
        F.pow(F.lit(2.0), "l_linenumber").alias("doubled"),
    )


# --- readers and writers --------------------------------------------------------------
# Each writes a file derived from the tables to the shared scratch folder and reads it back.


@register(
    "S1 P9 R1 G5",
    f"""WITH {PLACES_SQL}
SELECT country AS "Country", cnt AS "Count", rn AS "Day", nd AS "NumDays" FROM aligned""",
)
def wide_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracker's cohort preparation on a wide CSV file."""
    path = scratch_path(spark, "wide")
    wide_case_series(spark, sf_dir).write.option("header", True).csv(path)
    return country_curves(read_wide_series(spark, path))


@register(
    "S1 P9 R1 U1 G5 O2",
    f"""WITH {PLACES_SQL}
SELECT country AS "Country", CAST(q AS VARCHAR) AS date, cnt AS "Count", rn AS "Day", nd AS "NumDays" FROM aligned""",
)
def snapshot_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohort preparation on a folder of snapshots whose date columns are shifted, reordered and corrected.

    The older files are wrong by one in the dates that a newer file has as well.
    """
    whole = scratch_path(spark, "whole")
    wide_case_series(spark, sf_dir).write.parquet(whole)
    wide = spark.read.parquet(whole)
    dates = [c for c in wide.columns if c not in PLACE_COLUMNS]
    cut, overlap = len(dates) // 3, max(len(dates) // 6, 1)
    spans = [(0, cut + overlap), (cut, 2 * cut + overlap), (2 * cut, len(dates))]
    folder = scratch_path(spark, "snapshots")
    for at, (low, high) in enumerate(spans):
        follows = set(dates[spans[at + 1][0] :]) if at + 1 < len(spans) else set()
        cells = [(column(c) + (1 if c in follows else 0)).alias(c) for c in dates[low:high]]
        ids = [column(c) for c in PLACE_COLUMNS]
        # each file has its columns in another order, only the newest date stands last in all of them
        file = [*ids, *cells] if at == 0 else [*ids[::-1], *cells] if at == 1 else [*cells[:1], *ids, *cells[1:]]
        wide.select(file).write.mode("append").option("header", True).csv(folder)
    curves = snapshot_curves(read_series(spark, folder))
    return curves.select("Country", iso("Date").alias("date"), "Count", "Day", "NumDays")


_SCORES_ROWS_SQL = f"""WITH {NATION_YEARS_SQL}
SELECT {{columns}} FROM (
  SELECT n_name AS e, CASE n_name WHEN 'NATION_0' THEN 'BOL' WHEN 'NATION_1' THEN 'USA'
                      WHEN 'NATION_2' THEN 'KOR' WHEN 'NATION_6' THEN 'VEN' ELSE n_name END AS c,
         year AS y, CAST(n AS DOUBLE) AS s FROM ny)"""


@register("S2 S5", _SCORES_ROWS_SQL.format(columns='y AS "Year", e AS "Entity", s AS "Score"'))
def plain_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of the columns of a CSV file that starts with a byte order mark, found by their header names."""
    path = scratch_path(spark, "plain")
    rows = score_rows(spark, sf_dir).drop("Index")
    marked = rows.withColumnRenamed(rows.columns[0], f"\ufeff{rows.columns[0]}")
    marked.write.option("header", True).csv(path)
    return read_table(spark, path, "Year int, Entity string, Score double")


@register(
    "S3 P4", _SCORES_ROWS_SQL.format(columns='e AS place, c AS code, y AS period, s AS points')
)
def positional_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file whose columns are renamed in their order."""
    path = scratch_path(spark, "positional")
    score_rows(spark, sf_dir).drop("Index").write.option("header", True).csv(path)
    schema = "place string, code string, period int, points double"
    return read_table(spark, path, schema, by_position=True)


@register("S4 F5 C3 R2 D12 D17 U1 O3", VACCINATION_SQL)
def titled_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vaccination panel from CSV files with a title line above the header."""
    paths = []
    for wide in wide_vaccination(spark, sf_dir):
        path = scratch_path(spark, "titled")
        write_titled(wide, path, "Coverage report")
        paths.append((path, wide.columns[0]))
    return vaccination_panel(*[read_titled(spark, path, key) for path, key in paths])


def write_titled(wide: DataFrame, path: str, title: str) -> None:
    """Adds a CSV file with a title line above the header; the table has a row per place."""
    key, *names = wide.columns
    text = wide.select([column(c).cast("string").alias(c) for c in wide.columns])
    one = wide.sparkSession.range(0, 1, 1, 1)
    titles = one.select(F.lit(title).alias(key), *[F.lit("coverage").alias(y) for y in names])
    header = one.select([F.lit(c).alias(c) for c in wide.columns])
    # one file, in this order
    parts = [part.withColumn("_at", F.lit(at)) for at, part in enumerate((titles, header, text))]
    lines = parts[0].union(parts[1]).union(parts[2]).coalesce(1).sortWithinPartitions("_at")
    lines.drop("_at").write.mode("append").csv(path)


@register(
    "S4 S5 R2 D12 D17 P3",
    f"""WITH {NATION_YEARS_SQL},
years AS (SELECT CAST(unnest(range(min(year), max(year) + 1)) AS INTEGER) AS y FROM ny)
SELECT n.n_name AS "Region", years.y AS year, CAST(ny.n AS INTEGER) AS value
FROM (SELECT DISTINCT n_name FROM ny) n CROSS JOIN years
LEFT JOIN ny ON ny.n_name = n.n_name AND ny.year = years.y""",
)
def titled_folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year columns from files with other titles, other columns in another order, and a byte order mark."""
    whole = scratch_path(spark, "whole")
    wide_years(spark, sf_dir).write.parquet(whole)
    wide = spark.read.parquet(whole)
    years = wide.columns[1:]
    path = scratch_path(spark, "titled-folder")
    first = F.col("Region") < "NATION_2"
    write_titled(wide.where(first), path, "\ufeffOne report")
    write_titled(wide.where(~first).select("Region", *[column(y) for y in years[::-1][1:]], column(years[-1])), path, "Another title")
    return melt_years(read_titled(spark, path, "Region"), "Region", "year", "value")


_INDEX_SQL = """SELECT n_name AS "Country", upper(n_name) AS iso3c,
       CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) AS VARCHAR) AS date,
       count(*) FILTER (WHERE o_orderpriority = '1-URGENT') * 100 / count(*) AS "StringencyIndex",
       CAST(count(*) FILTER (WHERE o_orderstatus = 'P' AND o_totalprice > 450000) AS DOUBLE)
         AS "ConfirmedCases"
FROM (SELECT CASE n_name WHEN 'NATION_0' THEN 'Bolivia' WHEN 'NATION_1' THEN 'Corea del Sur'
              WHEN 'NATION_2' THEN 'EEUU' WHEN 'NATION_3' THEN 'Italia' WHEN 'NATION_5' THEN 'Brasil'
              WHEN 'NATION_6' THEN 'Ecuador' ELSE n_name END AS n_name, o_orderdate, o_orderpriority,
             o_orderstatus, o_totalprice
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
GROUP BY 1, 2, 3"""


@register("S7 D3 P3", _INDEX_SQL)
def typed_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five columns of a stringency export with 35 typed columns."""
    path = scratch_path(spark, "typed")
    filled = {
        "CountryName": F.col("Country"),
        "CountryCode": F.upper("Country"),
        "Date": F.date_format("Date", "yyyyMMdd"),
        "ConfirmedCases": F.col("ConfirmedCases"),
        "StringencyIndex": F.col("StringencyIndex"),
    }
    export = index_rows(spark, sf_dir).select(
        [filled.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in export_schema()]
    )
    export.write.option("header", True).csv(path)
    read = read_stringency(spark, path)
    return read.select(
        "Country", "iso3c", F.col("Date").cast("string").alias("date"), "StringencyIndex",
        "ConfirmedCases",
    )


@register("S6 R4 D18 G6", DEPARTMENTS_SQL)
def nested_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Department curves from JSON documents."""
    path = scratch_path(spark, "nested")
    department_document(spark, sf_dir).write.json(path)
    document = read_departments(spark, path, one_document=False)
    curves = department_curves(document, newest_record(document), "decesos", EVENT_TYPES)
    return curves.select(
        F.col("Fecha").cast("string").alias("date"), "Dpto", "Count", "Day", "NumDays"
    )


@register(
    "K1 K3",
    f"""WITH {USER_COHORT_SQL}
SELECT user_id, CAST(d AS VARCHAR) AS date, cnt AS "Count", rn AS "Day", nd AS "NumDays" FROM coh""",
)
def chart_table_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user cohort written as Parquet."""
    path = scratch_path(spark, "chart")
    save_chart_table(event_cohort(spark, sf_dir, "user_id"), path)
    return spark.read.parquet(path).withColumn("date", iso("date"))


@register(
    "K1 J1 W1 W2 F6",
    f"""WITH {USER_COHORT_SQL},
types AS (SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1)
SELECT user_id, CAST(d AS VARCHAR) AS date, cnt AS "Count", rn AS "Day", nd AS "NumDays", kinds FROM coh JOIN types USING (user_id)""",
)
def bucketed_cohort_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user cohort and a join by user from tables that are bucketed by user."""
    name = f"cohort_{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    daily = event_series(spark, sf_dir, "user_id")
    kinds = events.groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"))
    stored = save_bucketed(daily, f"{name}_days", "user_id", 8, ["date"], scratch_path(spark, "days"))
    types = save_bucketed(kinds, f"{name}_kinds", "user_id", 8, path=scratch_path(spark, "kinds"))
    cohort = align_since_threshold(stored, "user_id", "date", "Count", 10).join(types, "user_id")
    return cohort.select("user_id", iso("date"), "Count", "Day", "NumDays", "kinds")


# Names with accents and in both cases, whose order by code point is another one.
ACCENTED_NAMES = {
    "NATION_0": "Potosí", "NATION_1": "Potosz", "NATION_2": "potosa", "NATION_3": "Zeta", "NATION_4": "beni",
    "NATION_5": "Álava", "NATION_6": "alba", "NATION_7": "Éire", "NATION_8": "El Alto",
}


@register(
    "O3 O6 A9",
    f"""WITH {NATION_YEARS_SQL},
named AS (SELECT {case_sql("n_name", ACCENTED_NAMES)} AS place, CAST(sum(n) AS BIGINT) AS orders FROM ny GROUP BY 1)
SELECT place, orders, dense_rank() OVER (ORDER BY strip_accents(lower(replace(place, '_', ' ')))) AS place_ord FROM named""",
)
def locale_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by place with the place's rank as readers expect it."""
    named = nation_years(spark, sf_dir).groupBy(recode("n_name", ACCENTED_NAMES).alias("place"))
    totals = named.agg(F.sum("n").alias("orders"))
    return with_locale_rank(totals, "place", "place_ord")


@register("K2 K3", doubling_sql(USER_COHORT_SQL, "user_id"))
def summary_table_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The doubling-time table written as CSV."""
    path = scratch_path(spark, "summary")
    table_ = doubling_table(event_runs(spark, sf_dir, "user_id"), "user_id", "Count")
    save_summary_table(table_, path)
    return spark.read.option("header", True).schema(table_.schema).csv(path)


@register(
    "O2 P9 P10",
    """SELECT CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS newest_day, count(*) AS events
FROM events WHERE CAST(ts AS DATE) = (SELECT CAST(max(ts) AS DATE) FROM events)""",
)
def newest_day_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of events on the newest day."""
    events = table(spark, sf_dir, "events")
    newest = F.to_date(latest(events, "ts")).cast("timestamp_ntz")
    return events.filter(F.col("ts") >= newest).agg(
        F.to_date(F.max("ts")).cast("string").alias("newest_day"),
        F.count(F.lit(1)).alias("events"),
    )
