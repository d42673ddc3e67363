"""Registered queries against their SQL, and the shape of their plans."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from cohortline.catalog import all_queries, all_sql, operators_by_query

DATA = Path("/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES = all_queries()
SQL = all_sql()

# Every operator of the inventory in the design document.
INVENTORY = (
    [f"S{i}" for i in range(1, 9)]
    + [f"K{i}" for i in range(1, 4)]
    + [f"P{i}" for i in range(1, 12)]
    + [f"F{i}" for i in range(1, 13)]
    + [f"C{i}" for i in range(1, 9)]
    + [f"J{i}" for i in range(1, 7)]
    + [f"A{i}" for i in range(1, 12)]
    + [f"W{i}" for i in range(1, 9)]
    + [f"G{i}" for i in range(1, 11)]
    + ["R1", "R2", "R2b", "R3", "R4", "R5"]
    + [f"O{i}" for i in range(1, 7)]
    + [f"U{i}" for i in range(1, 5)]
    + [f"D{i}" for i in range(1, 19)]
)

needs_data = pytest.mark.skipif(not DATA.is_dir(), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    yield con
    con.close()


def comparable(value):
    return value if value is None or isinstance(value, (int, float, str)) else str(value)


def ordered(rows):
    return sorted(rows, key=lambda row: [(v is not None, str(type(v)), v) if v is not None else (False,) for v in row])


def test_every_operator_has_a_query():
    covered = {op for ops in operators_by_query().values() for op in ops}
    assert not set(INVENTORY) - covered
    assert set(SQL) == set(QUERIES)


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    cursor = duck.execute(SQL[name])
    sql_columns = [d[0] for d in cursor.description]
    assert sorted(sql_columns) == columns
    places = [sql_columns.index(c) for c in columns]
    expected = [tuple(comparable(row[i]) for i in places) for row in cursor.fetchall()]
    got = [tuple(comparable(row[c]) for c in columns) for row in df.collect()]
    assert len(got) == len(expected)
    assert ordered(got) == ordered(expected)


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_python_no_cross_join_and_no_single_task_window(spark, name):
    df = QUERIES[name](spark, str(DATA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|ArrowEval|Pandas", plan)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)
    for first in re.findall(r"windowspecdefinition\(([^,)]*)", plan):
        # without a partition key, the first argument is a sort order or the frame
        assert not re.search(r" ASC| DESC|specifiedwindowframe", first)


@needs_data
def test_flagship_shuffles_once_by_user(spark, final_plans):
    """After the counts per user and day, one partitioning serves windows and aggregate.

    The newest day is taken from the same counts: beside them and the user's rows, one value is exchanged.
    """
    df = contract.entry(spark)
    ran = final_plans(df)
    assert len(re.findall(r"- Exchange ", ran)) == 3 and ran.count("ReusedExchange") == 1
    assert ran.count("Scan ") == 1
    executed = df._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in executed.splitlines() if "ReadSchema" in line and "user_id" in line)
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>", scan)
    assert df.count() > 0


@needs_data
def test_newest_date_filter_reaches_the_scan(spark):
    plan = QUERIES["latest_rows"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^]]*ScalarSubquery", plan)


@needs_data
@pytest.mark.parametrize(
    ("name", "column"),
    [("region_weighted", "o_orderdate"), ("education_panel_brands", "l_shipdate")],
)
def test_year_bounds_reach_the_scan(spark, name, column):
    plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PushedFilters: \[[^]]*GreaterThanOrEqual\({column},", plan)


def test_no_broadcast_hints_and_no_local_checkpoints():
    package = Path(__file__).resolve().parents[1] / "cohortline"
    for source in package.rglob("*.py"):
        if source.parent.name == "llm":  # has its own tests
            continue
        text = source.read_text(encoding="utf-8")
        for word in ("broadcast(", "localCheckpoint", "crossJoin", ".rdd", "pandas_udf", "F.udf"):
            assert word not in text, f"{word} in {source.name}"
