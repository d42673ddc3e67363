"""Reshaping, stacking, level orders and newest-date operators."""

from datetime import date

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortline.operators.latest import (
    drop_latest,
    keep_latest,
    last_column,
    latest,
    rows_for_entity,
    value_at_latest,
)
from cohortline.operators.reshape import explode_records, melt, melt_positions, name_at, spread
from cohortline.operators.stacking import (
    bind_rows,
    overlay,
    with_first_appearance,
    with_locale_rank,
    with_total_level,
)


def test_melt_keeps_nulls_and_odd_names(spark, rows):
    wide = spark.createDataFrame([("a", 1, None), ("b", 3, 4)], "id string, `1/22/20` int, `x.y` int")
    assert rows(melt(wide, ["id"], "date", "n")) == [
        ("a", "1/22/20", 1),
        ("a", "x.y", None),
        ("b", "1/22/20", 3),
        ("b", "x.y", 4),
    ]
    assert rows(melt(wide, ["id"], measures=["x.y"])) == [("a", "x.y", None), ("b", "x.y", 4)]


def test_melt_by_position_keeps_nulls(spark, rows):
    names = ["1/22/20", "1/23/20"]
    wide = spark.createDataFrame([("a", 1, None), ("b", 3, 4)], "id string, `1/22/20` int, `1/23/20` int")
    long = melt_positions(wide, ["id"], names, "p", "n")
    assert rows(long) == [("a", 0, 1), ("a", 1, None), ("b", 0, 3), ("b", 1, 4)]
    assert rows(long.select("id", name_at("p", names).alias("date"), "n")) == rows(
        melt(wide, ["id"], "date", "n")
    )


@settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.dictionaries(
        st.tuples(st.integers(0, 5), st.sampled_from("xyz")), st.integers(-9, 9), min_size=1
    )
)
def test_spread_then_melt_is_the_identity(spark, cells):
    long = spark.createDataFrame([(i, k, v) for (i, k), v in cells.items()], "id int, key string, v int")
    wide = spread(long, ["id"], "key", ["x", "y", "z"], "v")
    back = melt(wide, ["id"], "key", "v").filter("v IS NOT NULL")
    assert {(r.id, r.key): r.v for r in back.collect()} == cells


def test_explode_records(spark, rows):
    df = spark.createDataFrame(
        [([("2020-03-02", {"x": 1.0, "y": 2.0}), ("2020-03-01", {"x": 0.5})],)],
        "records array<struct<fecha:string,dep:map<string,double>>>",
    )
    assert rows(explode_records(df, "records", "fecha", "dep", "key", "n")) == [
        (0, "2020-03-02", "x", 1.0),
        (0, "2020-03-02", "y", 2.0),
        (1, "2020-03-01", "x", 0.5),
    ]


def test_rows_bind_by_name(spark, rows):
    a = spark.createDataFrame([("a", 2000, 1.0)], "Entity string, Year int, Score double")
    b = spark.createDataFrame([(2001, 2.0, "b")], "Year int, Score double, Entity string")
    assert rows(bind_rows(a, b, a)) == [("a", 2000, 1.0), ("a", 2000, 1.0), ("b", 2001, 2.0)]
    assert rows(bind_rows(a, b.drop("Score"), fill=True)) == [("a", 2000, 1.0), ("b", 2001, None)]


def test_overlay_tags_layers(spark, rows):
    a = spark.createDataFrame([(1,)], "x int")
    assert rows(overlay({"one": a, "two": a})) == [(1, "one"), (1, "two")]


def test_total_level_is_strict(spark, rows):
    df = spark.createDataFrame(
        [("a", 1, 2), ("a", 1, 3), ("b", 1, 4), ("a", 2, 5), ("b", 2, None)],
        "e string, d int, n int",
    )
    assert rows(with_total_level(df, "e", ["d"], "n", "all"), "d", "e", "n") == [
        (1, "a", 5),
        (1, "all", 9),
        (1, "b", 4),
        (2, "a", 5),
        (2, "all", None),
        (2, "b", None),
    ]


def test_first_appearance(spark, rows):
    df = spark.createDataFrame([(3, "b"), (1, "c"), (2, "b"), (4, "a"), (5, None)], "pos int, v string")
    out = with_first_appearance(df, "v", "pos", "first")
    assert rows(out, "pos", "v", "first") == [(1, "c", 1), (2, "b", 2), (3, "b", 2), (4, "a", 4), (5, None, 5)]


def test_newest_date(spark, rows):
    df = spark.createDataFrame(
        [("a", date(2020, 1, 1), 1), ("a", date(2020, 1, 3), 2), ("b", date(2020, 1, 3), 5)],
        "e string, d date, n int",
    )
    assert rows(keep_latest(df, "d"), "e", "n") == [("a", 2), ("b", 5)]
    assert rows(drop_latest(df, "d"), "e", "n") == [("a", 1)]
    assert rows(value_at_latest(df, "d", "n", "e"), "e", "n") == [("a", 2), ("b", 5)]
    assert df.select(latest(df, "d")).first()[0] == date(2020, 1, 3)


def test_one_value_per_matching_row(spark, rows):
    wide = spark.createDataFrame([("Bolivia", 1, 7), ("Bolivia", 2, 8), ("Peru", 3, 9)], "c string, `1/1/20` int, `1/2/20` int")
    assert last_column(wide) == "1/2/20"
    assert rows(rows_for_entity(wide, "c", "Bolivia", last_column(wide))) == [(7,), (8,)]


def test_locale_rank(spark, rows):
    names = ["Potosz", "Potosí", "potosi", "Zeta", "beni", "Ñuflo", "Nunez", "Oruro", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    ranks = dict(rows(with_locale_rank(df, "name", "at")))
    assert ranks == {"beni": 1, "Ñuflo": 2, "Nunez": 3, "Oruro": 4, "Potosí": 5, "potosi": 5, "Potosz": 6, "Zeta": 7, None: None}
    spanish = dict(rows(with_locale_rank(df, "name", "at", "es")))
    assert spanish["Nunez"] < spanish["Ñuflo"] < spanish["Oruro"] and spanish["potosi"] != spanish["Potosí"]
