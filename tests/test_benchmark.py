"""Means, weights, shares and ratios."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortline.operators.benchmark import (
    group_mean,
    keep_members,
    members,
    ratio_to_base,
    region_and_world_mean,
    segment_rates,
    share_of_total,
    weighted_by_population,
    weighted_rate,
    with_group_total,
)


def test_weights_are_not_renormalised(spark, rows):
    df = spark.createDataFrame(
        [(2000, 1.0, None), (2000, 3.0, 8.0), (2001, None, None), (2002, 0.0, 5.0)],
        "year int, pop double, x double",
    )
    assert rows(weighted_by_population(df, "year", "x", "pop"), "year", "x") == [
        (2000, 6.0),
        (2001, 0.0),
        (2002, 0.0),
    ]


def test_members_and_exclusions(spark, rows):
    dim = spark.createDataFrame(
        [("PE", "L"), ("PE", "L"), ("VE", "L"), ("FR", "E"), (None, "L")], "code string, region string"
    )
    codes = members(dim, "code", F.col("region") == "L", exclude=["VE"])
    assert rows(codes) == [("PE",)]
    df = spark.createDataFrame([("PE", 1), ("PE", 2), ("FR", 3), (None, 4)], "c string, n int")
    assert rows(keep_members(df, codes, "c"), "n") == [(1,), (2,)]


def test_group_mean_is_strict_and_rounds_to_even(spark, rows):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 1.0), (2, None)], "y int, x double")
    assert rows(group_mean(df, "y", "x", "e", "all"), "y", "x", "e") == [(1, 2.5, "all"), (2, None, "all")]
    assert rows(group_mean(df, "y", "x", "e", "all", 0), "y", "x") == [(1, 2.0), (2, None)]


def test_region_and_world_mean(spark, rows):
    df = spark.createDataFrame(
        [("PE", 1, 2.0), ("FR", 1, 4.0), (None, 1, 9.0), ("FR", 2, 1.0)], "c string, y int, x double"
    )
    codes = spark.createDataFrame([("PE",), ("PE",)], "code string")
    out = region_and_world_mean(df, codes, "c", "y", "x", "e", ("region", "world"))
    assert rows(out, "e", "y", "x") == [("region", 1, 2.0), ("world", 1, 5.0), ("world", 2, 1.0)]


def test_totals_and_shares(spark, rows):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("b", 3, 0.0)], "g string, i int, n double")
    assert rows(with_group_total(df, "g", "n", "t"), "i", "t") == [(1, 4.0), (2, 4.0), (3, 0.0)]
    shares = rows(share_of_total(df, "g", "n", "s"), "i", "s")
    assert shares[:2] == [(1, 0.25), (2, 0.75)] and math.isnan(shares[2][1])  # 0 of 0
    loose = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0)], "g string, i int, n double")
    assert rows(with_group_total(loose, "g", "n", "t"), "i", "t") == [(1, 3.0), (2, 3.0)]


def test_ratio_to_base(spark, rows):
    df = spark.createDataFrame(
        [("US", 1, 4.0), ("BO", 1, 1.0), ("KR", 1, None), ("BO", 2, 1.0), ("US", 3, 0.0), ("BO", 3, 1.0)],
        "c string, y int, x double",
    )
    assert rows(ratio_to_base(df, "c", "y", "x", "US", "r"), "c", "y", "r") == [
        ("BO", 1, 0.25),
        ("BO", 2, None),
        ("BO", 3, math.inf),
        ("KR", 1, None),
    ]


@settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.tuples(
            st.sampled_from("abc"),
            st.sampled_from(["young", "old"]),
            st.integers(1, 1000),
            st.integers(0, 100),
        ),
        min_size=1,
        max_size=30,
    )
)
def test_two_levels_equal_the_pooled_rate(spark, data):
    df = spark.createDataFrame(data, "c string, band string, pop int, lhc int")
    segments = segment_rates(df, ["c", "band"], "pop", "lhc", "rate")
    out = weighted_rate(segments, ["band"], "pop", "rate", "percent")
    shares = share_of_total(segments, "band", "pop", "share")
    spelled = shares.groupBy("band").agg((F.sum(F.col("share") * F.col("rate")) * 100).alias("percent"))
    expected = {
        band: 100 * sum(p * r / 100 for _, b, p, r in data if b == band) / sum(p for _, b, p, _ in data if b == band)
        for band in {d[1] for d in data}
    }
    for frame in (out, spelled):
        got = {r.band: r.percent for r in frame.collect()}
        assert got == pytest.approx(expected)


def test_a_missing_segment_makes_the_rate_missing(spark, rows):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 50), ("b", 3, 10)], "c string, pop int, lhc int")
    segments = segment_rates(df.withColumn("band", F.lit("x")), ["c", "band"], "pop", "lhc", "rate")
    assert rows(segments, "c", "pop", "rate") == [("a", 3, None), ("b", 3, pytest.approx(0.1))]
    assert rows(weighted_rate(segments, ["band"], "pop", "rate", "p"), "p") == [(None,)]
