"""Refresh by day and numbering in ranges, against full runs."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.operators.cohort import align_since_threshold
from cohortline.operators.doubling import doubling_times, interval_ends, times_of_ends
from cohortline.operators.long_series import align_by_span, running_total_by_span
from cohortline.operators.refresh import appended_rows, cohort_state, refreshed_state, state_ends
from cohortline.operators.series import running_total

SCHEMA = "name string, at date, n double"
START = date(2020, 1, 1)


def frame(spark, values):
    return spark.createDataFrame([(e, START + timedelta(d), float(n)) for (e, d), n in values.items()], SCHEMA)


def plain(state):
    return sorted(
        (r["name"], r.last_date, r.last_count, r.NumDays, tuple((t.date, t["count"]) for t in r.tail)) for r in state.collect()
    )


@pytest.mark.parametrize("seed", range(4))
def test_refreshing_equals_a_full_run(spark, rows, seed):
    rng = np.random.default_rng(seed)
    values = {(e, d): rng.integers(5, 60) for e in "abcdefgh" for d in range(40) if rng.random() < 0.9 and (e != "h" or d > 37)}
    seen = {k: v for k, v in values.items() if k[1] < 25}
    state = cohort_state(frame(spark, seen), "name", "at", "n", 10)
    for low, high in ((25, 26), (26, 33), (33, 40)):
        changed = {k: v for k, v in values.items() if low <= k[1] < high}
        for e in rng.choice(list("abcdefg"), 2, replace=False):  # corrections of any earlier day, present or not
            changed[str(e), int(rng.integers(0, low))] = values[str(e), int(rng.integers(0, 1))] = int(rng.integers(5, 60))
        seen |= changed
        state = refreshed_state(state, frame(spark, changed), frame(spark, seen), "name", "at", "n", 10)
        state = spark.createDataFrame(state.collect(), state.schema)
        full = frame(spark, seen)
        assert plain(state) == plain(cohort_state(full, "name", "at", "n", 10))
        aligned = align_since_threshold(full, "name", "at", "n", 10)
        assert rows(state_ends(state, "name")) == rows(interval_ends(aligned, "name", "n"))
        assert rows(times_of_ends(state_ends(state, "name"), "name")) == rows(doubling_times(aligned, "name", "n"))


def test_appended_rows_continue_the_curves(spark, rows):
    old = {("a", d): 10 + d for d in range(40)} | {("b", d): 3 for d in range(3)}
    new = {("a", 40): 9, ("a", 41): 60, ("b", 3): 12, ("c", 2): 30, ("c", 3): 40}
    state = cohort_state(frame(spark, old), "name", "at", "n", 10)
    late = {("b", 1): 50, ("b", 4): 70}
    added = appended_rows(state, frame(spark, new), "name", "at", "n", 10)
    assert rows(added, "name", "n", "Day") == [("a", 60.0, 41), ("b", 12.0, 1), ("c", 30.0, 1), ("c", 40.0, 2)]
    assert appended_rows(state, frame(spark, late), "name", "at", "n", 10).count() == 0


def test_states_of_nothing(spark):
    none = frame(spark, {})
    state = cohort_state(none, "name", "at", "n", 10)
    assert state.count() == 0
    first = {("a", 0): 11, ("b", 0): 2}
    grown = refreshed_state(state, frame(spark, first), frame(spark, first), "name", "at", "n", 10)
    assert plain(grown) == plain(cohort_state(frame(spark, first), "name", "at", "n", 10))
    assert plain(refreshed_state(grown, none, frame(spark, first), "name", "at", "n", 10)) == plain(grown)


def test_only_corrected_entities_are_computed_again(spark):
    values = {(e, d): 20 for e in "abc" for d in range(5)}
    state = cohort_state(frame(spark, values), "name", "at", "n", 10)
    elsewhere = frame(spark, {("b", d): 30 for d in range(9)})  # a history that differs shows which rows were used
    change = frame(spark, {("b", 2): 30, ("a", 5): 25})
    got = {r["name"]: r.NumDays for r in refreshed_state(state, change, elsewhere, "name", "at", "n", 10).collect()}
    assert got == {"a": 6, "b": 9, "c": 5}


def test_one_long_series_is_numbered_in_ranges(spark, rows):
    days = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("name"),
        F.date_add(F.lit(START), F.col("id").cast("int")).alias("at"),
        (F.pmod(F.hash("id"), F.lit(5)) - 1).alias("n"),
    )
    span = F.trunc("at", "month")
    total = running_total_by_span(days, "name", "at", "n", span)
    assert rows(total) == rows(running_total(days, "name", "at", "n"))
    ranged = align_by_span(total, "name", "at", "n", 10, span)
    whole = align_since_threshold(total, "name", "at", "n", 10)
    assert rows(ranged) == rows(whole)
    held = sorted(r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        held = sorted(r["count"] for r in align_by_span(total, "name", "at", "n", 10, span).groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(held) == 8 and held[-1] <= 2 * held[len(held) // 2]


def test_spans_with_missing_values(spark, rows):
    df = spark.createDataFrame(
        [("a", START, None), ("a", START + timedelta(40), 5.0), (None, START, 7.0), (None, START + timedelta(1), 8.0)], SCHEMA
    )
    span = F.trunc("at", "month")
    assert rows(running_total_by_span(df, "name", "at", "n", span)) == rows(
        running_total(df, "name", "at", "n").withColumn("n", F.col("n"))
    )
    assert align_by_span(df.limit(0), "name", "at", "n", 1, span).count() == 0
