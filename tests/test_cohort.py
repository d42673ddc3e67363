"""Cohort alignment, labels, doubling times and growth lines."""

from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortline.operators.cohort import (
    align_runs,
    align_since_threshold,
    comparison_subset,
    label_last_day,
    label_maximum,
)
from cohortline.operators.doubling import (
    WEEK_HEADERS,
    doubling_table,
    doubling_times,
    focal_first,
    interval_ends,
)
from cohortline.operators.growth import DEPARTMENT_RATES, growth_lines
from cohortline.operators.overlay import axis_domain, clip_counts, two_scales
from cohortline.operators.series import carry_forward, count_by_date, running_total, total_by_date

START = date(2020, 3, 1)


def series_frame(spark, series):
    """One row per entity and day from lists of counts."""
    data = [
        (name, START + timedelta(days=i), float(c) if c is not None else None)
        for name, counts in series.items()
        for i, c in enumerate(counts)
    ]
    return spark.createDataFrame(data, "e string, date date, Count double").repartition(4)


def aligned_frame(spark, series, threshold=10, latest=None):
    return align_since_threshold(series_frame(spark, series), "e", "date", "Count", threshold, latest)


def test_rows_below_the_threshold_close_up(spark, rows):
    out = aligned_frame(spark, {"a": [9, 10, 12, 9, 11]})
    assert rows(out, "Count", "Day", "NumDays") == [(10.0, 1, 3), (11.0, 3, 3), (12.0, 2, 3)]


def test_having_on_the_newest_date(spark, rows):
    series = {"falls": [20, 30, 9], "stays": [5, 10, 10], "gap": [20, 20, None]}
    out = aligned_frame(spark, series, latest=START + timedelta(days=2))
    assert rows(out, "e", "Count", "Day") == [("stays", 10.0, 1), ("stays", 10.0, 2)]


def test_missing_counts_drop_out(spark, rows):
    out = aligned_frame(spark, {"a": [10, None, 12]})
    assert rows(out, "Count", "Day", "NumDays") == [(10.0, 1, 2), (12.0, 2, 2)]


def test_last_day_and_maximum_labels(spark, rows):
    aligned = aligned_frame(spark, {"a": [10, 30, 30, 20]})
    assert rows(label_last_day(aligned, "e"), "Day", "label") == [
        (1, None),
        (2, None),
        (3, None),
        (4, "a"),
    ]
    assert rows(label_maximum(aligned, "e", "Count"), "Day", "label") == [
        (1, None),
        (2, "a"),
        (3, "a"),
        (4, None),
    ]


def test_comparison_subset_reverses_the_listing(spark, rows):
    aligned = aligned_frame(spark, {"a": [10], "b": [10], "c": [10], "d": [10]})
    out = comparison_subset(aligned, "e", "b", ["a", "d"])
    assert rows(out, "e", "label", "e_ord") == [("a", "a", 2), ("b", "b", 3), ("d", "d", 1)]


DOUBLING_CASES = {
    "single": ([10], ["Sin Cambio"] * 4),
    "seven": ([10, 11, 12, 13, 14, 15, 16], ["NA"] * 4),
    "week": ([10, 11, 12, 13, 14, 15, 16, 20], ["7 días", "NA", "NA", "NA"]),
    "flat": ([12] * 15, ["Sin Cambio", "Sin Cambio", "NA", "NA"]),
    "falls": ([20, 19, 18, 17, 16, 15, 14, 10], ["-7 días", "NA", "NA", "NA"]),
    "month": ([10 * 2 ** (t // 7) for t in range(29)], ["7 días"] * 4),
}


def test_doubling_table(spark):
    aligned = aligned_frame(spark, {k: v[0] for k, v in DOUBLING_CASES.items()})
    table = doubling_table(aligned, "e", "Count")
    assert table.columns == ["e", *WEEK_HEADERS]
    assert {r[0]: list(r)[1:] for r in table.collect()} == {k: v[1] for k, v in DOUBLING_CASES.items()}


def test_doubling_times_leave_missing_cells_null(spark):
    aligned = aligned_frame(spark, {"week": DOUBLING_CASES["week"][0]})
    assert list(doubling_times(aligned, "e", "Count").first())[1:] == ["7", None, None, None]


def test_interval_ends_look_from_the_last_row(spark):
    aligned = aligned_frame(spark, {"a": range(10, 25)})
    assert tuple(interval_ends(aligned, "e", "Count", 7, 2).first()) == ("a", 15, 24.0, 17.0, 10.0)


def test_focal_comes_first(spark):
    table = spark.createDataFrame([("c",), ("a",), ("b",)], "e string")
    assert [r.e for r in focal_first(table, "e", "b").collect()] == ["b", "a", "c"]


def brute_doubling(counts, threshold):
    """The table's cells straight from the list of counts."""
    import math

    kept = [c for c in counts if c is not None and c >= threshold]
    n, cells = len(kept), []
    for k in range(1, 5):
        last, first = n - 7 * (k - 1) - 1, n - 7 * k - 1
        if n == 1:
            cells.append("Sin Cambio")
        elif first < 0:
            cells.append("NA")
        elif kept[last] == kept[first]:
            cells.append("Sin Cambio")
        else:
            days = 7 * math.log(2) / math.log(kept[last] / kept[first])
            cells.append(f"{round(days)} días")
    return n, cells


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.lists(st.one_of(st.none(), st.integers(5, 60)), min_size=1, max_size=32),
        min_size=1,
        max_size=12,
    )
)
def test_doubling_agrees_with_brute_force(spark, lists):
    series = {f"s{i}": counts for i, counts in enumerate(lists)}
    aligned = aligned_frame(spark, series)
    got = {r[0]: list(r)[1:] for r in doubling_table(aligned, "e", "Count").collect()}
    days = {}
    for r in aligned.collect():
        assert r.Count >= 10
        days.setdefault(r.e, []).append((r.Day, r.NumDays))
    for name, counts in series.items():
        n, cells = brute_doubling(counts, 10)
        assert sorted(days.get(name, [])) == [(d, n) for d in range(1, n + 1)]
        assert got.get(name) == (cells if n else None)


@pytest.mark.parametrize("rate", [1, 2, 3, 7, 14, 30])
def test_exact_growth_gives_back_its_rate(spark, rate):
    aligned = aligned_frame(spark, {"a": [1000 * 2 ** (t / rate) for t in range(29)]})
    cells = list(doubling_table(aligned, "e", "Count").first())[1:]
    assert cells == [f"{rate} días"] * 4


def test_growth_lines(spark, rows):
    aligned = aligned_frame(spark, {"a": [10, 20, 40]})
    lines = growth_lines(aligned, "e", "Count", 10, DEPARTMENT_RATES)
    assert lines.count() == 6 * 14
    assert rows(lines.filter("Day = 2"), "e", "Count", "NumDays") == [
        ("cada_2_semanas", 11.0, 14),
        ("cada_dia", 20.0, 14),
        ("cada_dos_dias", 14.0, 14),
        ("cada_mes", 10.0, 14),
        ("cada_semana", 11.0, 14),
        ("cada_tres_dias", 13.0, 14),
    ]
    series = lines.filter("e = 'cada_mes'").orderBy("Day").collect()
    counts = [r.Count for r in series]
    assert counts == sorted(counts)
    assert [r.label for r in series] == [
        "cada_mes" if c == max(counts) else None for c in counts
    ]


def test_axis_domain_and_clipping(spark, rows):
    aligned = aligned_frame(spark, {"a": [10, 120]})
    assert tuple(axis_domain(aligned, "Count").first()) == (2, 32, 120.0, 3, 10000.0)
    df = spark.createDataFrame([(9.0,), (10.0,), (10000.0,), (10001.0,)], "Count double")
    assert [r[0] for r in clip_counts(df, "Count", aligned).orderBy("Count").collect()] == [
        None,
        None,
        10.0,
        10000.0,
    ]


def test_two_scales(spark):
    df = spark.createDataFrame(
        [(1, 0.0, 50.0), (2, 1000.0, 10.0), (101, None, 90.0), (200, 10.0, 100.0)],
        "Day int, cases double, idx double",
    )
    out = two_scales(df, "cases", "idx").orderBy("Day").collect()
    assert [tuple(r[c] for c in ("day_drawn", "count_drawn", "index_drawn")) for r in out] == [
        (1, None, 2.5),
        (2, 3.0, None),
        (None, 1.0, 5.0),
    ]
    assert out[0].count_log10 == float("-inf")


def test_cumulative_daily_series(spark):
    stamps = [("a", "2020-03-01"), ("a", "2020-03-01"), ("a", "2020-03-04"), ("b", "2020-03-02")]
    events = spark.createDataFrame(stamps, "e string, d string")
    daily = count_by_date(events, "e", F.to_date("d"), "date", "n")
    filled = carry_forward(
        running_total(daily, "e", "date", "n"), "e", "date", F.lit(date(2020, 3, 5))
    )
    got = sorted((r.e, r.date.day, r.n) for r in filled.collect())
    assert got == [
        ("a", 1, 2),
        ("a", 2, 2),
        ("a", 3, 2),
        ("a", 4, 3),
        ("a", 5, 3),
        ("b", 2, 1),
        ("b", 3, 1),
        ("b", 4, 1),
        ("b", 5, 1),
    ]


@settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.dictionaries(
        st.tuples(st.sampled_from("abcd"), st.integers(0, 40)), st.integers(5, 30), min_size=1
    )
)
def test_runs_number_the_days_like_the_filled_series(spark, counts):
    data = [(e, START + timedelta(days=d), c) for (e, d), c in counts.items()]
    sparse = spark.createDataFrame(data, "e string, date date, Count int")
    last = F.lit(START + timedelta(days=35))
    filled = carry_forward(sparse, "e", "date", last)
    aligned = align_since_threshold(filled, "e", "date", "Count", 10)
    runs = align_runs(sparse, "e", "date", "Count", 10, last)
    assert sorted((r.e, r.Day, r.NumDays, r.Count) for r in aligned.collect()) == sorted(
        (r.e, day, r.NumDays, r.Count) for r in runs.collect() for day in range(r.Day, r.LastDay + 1)
    )
    tables = [doubling_table(a, "e", "Count") for a in (aligned, runs)]
    assert sorted(map(tuple, tables[0].collect())) == sorted(map(tuple, tables[1].collect()))


def test_total_by_date_is_strict(spark, rows):
    df = spark.createDataFrame(
        [("a", "d1", 1), ("a", "d1", None), ("a", "d2", 2), ("a", "d2", 3)],
        "e string, d string, n int",
    )
    assert rows(total_by_date(df, "e", "d", "n")) == [("a", "d1", None), ("a", "d2", 5)]
