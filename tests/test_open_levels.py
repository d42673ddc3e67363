"""Queries on tables with levels, places and days that no list in the code names."""

import shutil
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortline.catalog import all_queries, all_sql
from cohortline.operators.latest import drop_latest, keep_latest, latest_of_series, levels_of_series
from cohortline.operators.reshape import found_levels, level_map, spread

DATA = Path("/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
NAMES = (
    "pivot_status horizontal_total record_entries json_entries department_curves_json nested_json_scan "
    "department_tracker_curves department_tracker_doubling country_tracker_totals country_tracker_curves "
    "doubling_time_types doubling_time_users latest_rows drop_latest_date newest_day_events cohort_nations_having"
).split()

needs_data = pytest.mark.skipif(not DATA.is_dir(), reason="driver tables not present")


@pytest.fixture(scope="module")
def changed(spark, tmp_path_factory):
    """The tables with one more status and event type, a place without finished orders, and times of day."""
    folder = tmp_path_factory.mktemp("changed")
    for name in TABLES:
        shutil.copy(DATA / f"{name}.parquet", folder)
    con = duckdb.connect()
    con.execute(
        f"""COPY (SELECT o_orderkey, o_custkey, CASE WHEN c_nationkey = 0 AND o_orderstatus = 'F' THEN 'P'
                    WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice,
                    o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24) AS o_orderdate, o_orderpriority
             FROM '{DATA}/orders.parquet' JOIN '{DATA}/customer.parquet' ON c_custkey = o_custkey)
            TO '{folder}/orders.parquet'"""
    )
    con.execute(
        f"""COPY (SELECT * REPLACE (CASE WHEN event_id % 5 = 0 THEN 'refund' ELSE event_type END AS event_type)
                  FROM '{DATA}/events.parquet') TO '{folder}/events.parquet'"""
    )
    return folder


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_added_levels_stay(spark, changed, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{changed}/{table}.parquet'")
    cursor = con.execute(all_sql()[name])
    columns = [d[0] for d in cursor.description]
    expected = sorted((tuple(map(str, r)) for r in cursor.fetchall()))
    df = all_queries()[name](spark, str(changed))
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == expected


@needs_data
def test_the_new_levels_are_in_the_results(spark, changed):
    queries = all_queries()
    assert "X" in queries["pivot_status"](spark, str(changed)).columns
    assert {"refund"} <= {r.Dpto for r in queries["department_tracker_curves"](spark, str(changed)).collect()}
    totals = queries["country_tracker_totals"](spark, str(changed)).collect()
    assert {r.value for r in totals if r.layer == "total_fallecidos"} == {0.0}
    assert len([r for r in totals if r.layer == "total_fallecidos"]) == len([r for r in totals if r.layer == "total_confirmados"])


@needs_data
@pytest.mark.parametrize("name", ["doubling_time_users", "doubling_time_types", "cohort_users", "interval_ends_users"])
def test_newest_date_costs_no_second_scan(spark, final_plans, name):
    assert final_plans(all_queries()[name](spark, str(DATA))).count("Scan ") == 1


def test_level_map_and_discovered_columns(spark, rows):
    df = spark.createDataFrame(
        [(1, "a", 2), (1, "a", 5), (1, "c", None), (2, "b", 1), (2, None, 9)], "id int, key string, value int"
    )
    assert rows(level_map(df, ["id"], "key", "value", "m")) == [(1, {"a": 5, "c": None}), (2, {"b": 1})]
    wide = spread(df, ["id"], "key", None, "value")
    assert wide.columns == ["id", "a", "b", "c"]
    assert rows(wide) == [(1, 5, None, None), (2, None, 1, None)]
    assert rows(spread(df, ["id"], "key", ["b", "z"], "value")) == [(1, None, None), (2, 1, None)]
    with pytest.raises(ValueError, match="level_map"):
        found_levels(df, "key", most=2)
    assert found_levels(df.limit(0), "key") == []


def test_newest_day_of_times(spark, rows):
    df = spark.createDataFrame([(1, "2020-01-01 10:00"), (2, "2020-01-02 00:00"), (3, "2020-01-02 23:59"), (4, None)], "id int, t string")
    for kind in ("timestamp", "timestamp_ntz", "date"):
        timed = df.withColumn("t", F.col("t").cast(kind))
        assert rows(keep_latest(timed, "t"), "id") == [(2,), (3,)]
        assert rows(drop_latest(timed, "t"), "id") == [(1,)]


def test_newest_date_and_labels_of_a_series(spark):
    df = spark.createDataFrame([("b", 1, 2), ("a", 3, None), ("b", 2, 4), (None, 9, 1)], "name string, day int, n int")
    series = df.groupBy("name", "day").agg(F.sum("n").alias("n"))
    found = spark.range(1).select(latest_of_series(series, "day", "n").alias("d"), levels_of_series(series, "name", "n").alias("l"))
    assert tuple(found.first()) == (9, ["a", "b"])
