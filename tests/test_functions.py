"""Column expressions: missing values, rounding, logarithms, dates, text and categories."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from cohortline.functions import (
    band_of,
    benchmark_class,
    blank_if,
    clip_to_domain,
    column,
    day_before,
    dmy,
    doubling_days,
    doubling_growth,
    fill_blank,
    first_match,
    half_even,
    horizontal_sum,
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
    strict_mean,
    strict_sum,
    sum_or_zero,
    swap,
    template,
    thousands,
    to_year,
    within_any_band,
)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_strict_sum_and_mean_are_null_if_any_input_is(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "k string, x double")
    out = df.groupBy("k").agg(strict_sum("x").alias("s"), strict_mean("x").alias("m"))
    assert rows(out) == [("a", None, None), ("b", 6.0, 3.0)]


def test_sum_of_nothing_is_zero(spark, rows):
    df = spark.createDataFrame([("a", None), ("b", 2.0), ("b", None)], "k string, x double")
    assert rows(df.groupBy("k").agg(sum_or_zero("x").alias("s"))) == [("a", 0.0), ("b", 2.0)]


def test_strict_sum_keeps_decimals_exact(spark):
    df = spark.range(1000).select(F.lit("0.1").cast("decimal(18,2)").alias("x"))
    assert str(df.agg(strict_sum("x").alias("s")).first()[0]) == "100.00"
    assert df.agg(strict_mean("x").alias("m")).first()[0] == 0.1


def test_horizontal_sum_is_null_if_any_column_is(spark, rows):
    df = spark.createDataFrame([(1, 2), (1, None)], "a int, `b.c` int")
    assert [r[0] for r in df.select(horizontal_sum(["a", "b.c"])).collect()] == [3, None]


@pytest.mark.parametrize(("x", "expected"), [(2.5, 2.0), (-2.5, -2.0), (0.5, 0.0), (1.5, 2.0)])
def test_halves_go_to_the_even_neighbour(spark, x, expected):
    assert one(spark, half_even(F.lit(x))) == (expected,)


def test_log10_of_zero_and_negatives(spark):
    zero, hundred, negative, missing = one(
        spark,
        log10_ieee(F.lit(0)),
        log10_ieee(F.lit(100.0)),
        log10_ieee(F.lit(-1.0)),
        log10_ieee(F.lit(None)),
    )
    assert zero == -math.inf and hundred == 2.0 and math.isnan(negative) and missing is None


def test_ratio_by_zero(spark):
    inf = float("inf")
    cases = ratio(F.lit(1), F.lit(0)), ratio(F.lit(-2.5), F.lit(0)), ratio(F.lit(1), F.lit(4)), ratio(F.lit(None), F.lit(0))
    assert one(spark, *cases) == (inf, -inf, 0.25, None)
    assert one(spark, F.isnan(ratio(F.lit(0), F.lit(0))), F.isnan(ratio(F.lit(float("nan")), F.lit(0)))) == (True, True)


@pytest.mark.parametrize(
    ("x", "digits", "expected"),
    [
        (0.15, 1, 0.1), (0.25, 1, 0.2), (0.35, 1, 0.3), (0.45, 1, 0.4), (0.65, 1, 0.7), (-0.15, 1, -0.1), (2.5, 1, 2.5),
        (1.005, 2, 1.0), (2.675, 2, 2.67), (5.015, 2, 5.02), (0.125, 2, 0.12), (0.375, 2, 0.38), (1e300, 2, 1e300), (-7.0, 3, -7.0),
    ],
)
def test_rounding_to_decimals(spark, x, digits, expected):
    assert one(spark, half_even(F.lit(x), digits)) == (expected,)


def test_rounding_leaves_what_is_no_number(spark):
    values = [half_even(F.lit(v).cast("double"), 1) for v in (None, float("inf"), float("-inf"))]
    assert one(spark, *values, F.isnan(half_even(F.lit(float("nan")), 1))) == (None, float("inf"), float("-inf"), True)


def test_clip_blanks_values_outside(spark):
    out = one(spark, *[clip_to_domain(F.lit(x), 1, 5) for x in (0.9, 1.0, 5.0, -math.inf)])
    assert out == (None, 1.0, 5.0, None)


def test_doubling_growth_rounds_to_whole_counts(spark):
    lines = [doubling_growth(10, F.lit(r), F.lit(1)) for r in (1, 2, 3, 7, 14, 30)]
    assert one(spark, *lines) == (20.0, 14.0, 13.0, 11.0, 11.0, 10.0)


def test_doubling_days(spark):
    pairs = [(10, 20), (20, 10), (10, 40), (0, 5), (5, 0), (None, 5)]
    out = one(spark, *[doubling_days(F.lit(a), F.lit(b), 7) for a, b in pairs])
    assert out == (7.0, -7.0, 4.0, 0.0, 0.0, None)


def test_dates(spark):
    out = one(
        spark,
        parse_mdy(F.lit("1/22/20")),
        parse_mdy(F.lit("12/31/99")),
        parse_mdy(F.lit("2/29/96")),
        parse_iso(F.lit("2020-03-01")),
        parse_yyyymmdd(F.lit(20200122.0)),
        parse_iso(F.lit("no date")),
    )
    assert out == (
        date(2020, 1, 22),
        date(1999, 12, 31),
        date(1996, 2, 29),
        date(2020, 3, 1),
        date(2020, 1, 22),
        None,
    )
    first = F.lit(date(2020, 3, 1))
    assert one(spark, dmy(first), dmy(first, long_year=True), dmy(day_before(first))) == (
        "01/03/20",
        "01/03/2020",
        "29/02/20",
    )


def test_text(spark):
    out = one(
        spark,
        paste(F.lit(7), F.lit("días")),
        paste(F.lit(None), F.lit("días")),
        thousands(F.lit(1234567)),
        blank_if(F.lit("x"), "x"),
        fill_blank(F.lit(None).cast("string"), "NA"),
        swap(F.lit("old"), "old", "new"),
        template("%s of %s", F.lit(1), F.lit(None)),
    )
    assert out == ("7 días", "NA días", "1,234,567", None, "NA", "new", "1 of NA")


@pytest.mark.parametrize(
    ("name", "year"),
    [("2017", 2017), (" 2017", 2017), ("X2017", 2017), ("X.2017", 2017), ("total", None)],
)
def test_year_names(spark, name, year):
    assert one(spark, to_year(F.lit(name))) == (year,)


def test_column_takes_any_name(spark):
    df = spark.range(1).select(F.lit(1).alias("1/22/20"), F.lit(2).alias("a.b"), F.lit(3).alias("c`d"))
    assert tuple(df.select(column("1/22/20"), column("a.b"), column("c`d")).first()) == (1, 2, 3)


def test_recode_and_promote(spark):
    names = {"US": "EEUU"}
    out = one(
        spark,
        recode(F.lit("US"), names),
        recode(F.lit("Peru"), names),
        recode(F.lit(None).cast("string"), names),
        promote(F.lit("Hong Kong"), F.lit("China"), ["Hong Kong"]),
        promote(F.lit(None).cast("string"), F.lit("China"), ["Hong Kong"]),
    )
    assert out == ("EEUU", "Peru", None, "Hong Kong", "China")


def test_first_match_wins_and_falls_through(spark):
    rules = [("^rep.*korea", "Corea del Sur"), ("united st", "EEUU")]
    texts = ["Republic of Korea", "Democratic People's Republic of Korea", "United States", "Bolivia"]
    out = one(spark, *[first_match(F.lit(t), rules, "Bolivia") for t in texts])
    assert out == ("Corea del Sur", "Bolivia", "EEUU", "Bolivia")


def test_benchmark_classes_and_ranks(spark):
    names = ["Bolivia", "LATAM", "Peru", None]
    classes = one(spark, *[benchmark_class(F.lit(n).cast("string"), "Bolivia", ["LATAM"]) for n in names])
    assert classes == ("Bolivia", "Benchmark Regiones", "Benchmark Paises", None)
    ranks = one(spark, *[level_rank(F.lit(n).cast("string"), ["LATAM", "Bolivia"]) for n in names])
    assert ranks == (2, 1, None, None)
    turned = one(spark, *[reversed_level_rank(F.lit(n), ["a", "b", "c"]) for n in "abc"])
    assert turned == (3, 2, 1)


def test_bands(spark, rows):
    df = spark.createDataFrame([(25, 29), (30, 34), (25, 34), (55, 59)], "lo int, hi int")
    young, old = [(25, 29), (30, 34)], [(55, 59)]
    kept = df.filter(within_any_band("lo", "hi", young + old))
    out = kept.select("lo", band_of("lo", "hi", young, "young", "old").alias("band"))
    assert rows(out) == [(25, "young"), (30, "young"), (55, "old")]
