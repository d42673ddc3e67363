"""Whole pipelines on small inputs in their public layout."""

import time

import pytest
from pyspark.sql import functions as F

from cohortline.plans.panels import (
    education_panel,
    gdp_panel,
    newest_labels,
    regime_panel,
    satisfaction_panel,
)
from cohortline.plans.stringency import stringency_overlay
from cohortline.plans.tracker import (
    DEPARTMENTS,
    country_curves,
    country_total,
    country_tracker,
    department_curves,
    department_tracker,
    department_update_day,
    newest_record,
    update_label,
)
from cohortline.sources import read_wide_series

IDS = "`Province/State` string, `Country/Region` string, Lat double, Long double"


def wide(spark, places, days):
    header = ", ".join(f"`1/{22 + i}/20` double" for i in range(days))
    data = [(p, c, 0.0, 0.0, *[float(v) if v is not None else None for v in values]) for p, c, values in places]
    return spark.createDataFrame(data, f"{IDS}, {header}")


def test_country_curves(spark, rows):
    df = wide(
        spark,
        [
            ("Hong Kong", "China", [5, 10, 12]),
            ("Hubei", "China", [7, 70, 80]),
            ("Hunan", "China", [7, None, 20]),
            (None, "US", [1, 9, 11]),
            (None, "Bolivia", [10, 12, 9]),
        ],
        3,
    )
    out = country_curves(df, keep_date=True)
    assert [(c, str(d), n, day, total) for c, n, d, day, total in rows(out, "Country", "Count", "Date", "Day", "NumDays")] == [
        ("China", "2020-01-24", 100.0, 2, 2),
        ("China", "2020-01-22", 14.0, 1, 2),
        ("EEUU", "2020-01-24", 11.0, 1, 1),
        ("Hong Kong", "2020-01-23", 10.0, 1, 2),
        ("Hong Kong", "2020-01-24", 12.0, 2, 2),
    ]
    assert country_curves(df).columns == ["Country", "Count", "Day", "NumDays"]
    earlier = country_curves(df, latest="1/22/20")
    assert {r.Country for r in earlier.collect()} == {"Bolivia", "China"}


def test_many_derived_date_columns_plan_quickly(spark):
    """The optimizer must not enumerate combinations of renamed columns."""
    days = [f"{m}/{d}/20" for m in range(1, 7) for d in range(1, 21)]
    places = spark.createDataFrame([(None, "Bolivia", 4.0), (None, "Peru", 1.0)], "p string, c string, n double")
    df = places.select(
        F.col("p").alias("Province/State"),
        F.col("c").alias("Country/Region"),
        F.lit(0.0).alias("Lat"),
        F.lit(0.0).alias("Long"),
        *[F.coalesce(F.col("n") * i, F.lit(0.0)).alias(day) for i, day in enumerate(days)],
    )
    started = time.monotonic()
    out = country_curves(df).filter("Country = 'Bolivia'")
    assert out.count() == 117
    assert time.monotonic() - started < 60


def test_country_total_has_a_row_per_place(spark, rows):
    df = wide(spark, [(None, "Bolivia", [1, 12345]), ("x", "Bolivia", [1, 2]), (None, "Peru", [1, 9])], 2)
    assert rows(country_total(df)) == [(12345.0, "12,345"), (2.0, "2")]


def test_country_tracker_tables(spark, rows):
    cases = wide(spark, [(None, "Bolivia", range(10, 18)), (None, "Brazil", [12] * 8), (None, "Peru", [1] * 8)], 8)
    deaths = wide(spark, [(None, "Bolivia", [0] * 7 + [10]), (None, "Brazil", range(8))], 8)
    tables = country_tracker(cases, deaths)
    assert tables["encabezado"].first()[0] == "Última fecha de actualización:  29/01/2020"
    kinds = ("total", "curvas", "ejes", "lineas", "duplicacion")
    assert set(tables) == {
        "encabezado",
        *[f"{kind}_{measure}" for kind in kinds for measure in ("confirmados", "fallecidos")],
    }
    table = tables["duplicacion_confirmados"]
    assert [tuple(r)[:3] for r in table.select("Comparacion", *table.columns[:3]).collect()] == [
        ("referencia", "Bolivia", "9 días"),
        ("sudamerica", "Bolivia", "9 días"),
        ("sudamerica", "Brasil", "Sin Cambio"),
    ]
    curves = tables["curvas_confirmados"].filter("label IS NOT NULL")
    assert rows(curves, "Comparacion", "label", "Day", "Country_ord") == [
        ("referencia", "Bolivia", 8, 7),
        ("sudamerica", "Bolivia", 8, 10),
        ("sudamerica", "Brasil", 8, 8),
    ]
    deaths_table = tables["duplicacion_fallecidos"]
    assert {r["País"] for r in deaths_table.collect()} == {"Bolivia"}
    assert set(deaths_table.first()[1:5]) == {"Sin Cambio"}
    lines = tables["lineas_confirmados"].groupBy("Comparacion").count()
    assert rows(lines) == [("referencia", 5 * 19), ("sudamerica", 5 * 19)]
    axes = rows(tables["ejes_confirmados"], "Comparacion", "last_day", "last_break", "largest", "upper_limit")
    assert axes == [("referencia", 8, 38, 17.0, 1000.0), ("sudamerica", 8, 18, 17.0, 1000.0)]
    clipped = tables["lineas_confirmados"].filter("Comparacion = 'referencia' AND Country = 'cada_dia'").orderBy("Day")
    assert [(r.Count, r.drawn) for r in clipped.collect()][5:8] == [(320.0, 320.0), (640.0, 640.0), (1280.0, None)]


def test_stored_series_serve_all_tables(spark, tmp_path, rows):
    names = ",".join(["Province/State", "Country/Region", "Lat", "Long", *[f"1/{d}/20" for d in range(22, 31)]])
    frames = []
    for at, shift in (("cases", 10), ("deaths", 4)):
        lines = [f"{p},{c},0,0," + ",".join(str(shift + i * k) for i in range(9)) for p, c, k in (("", "Bolivia", 2), ("x", "Bolivia", 1), ("", "Peru", 3))]
        (tmp_path / f"{at}.csv").write_text("\n".join([names, *lines, "Hong Kong,China,0,0" + ",NA" * 9, ""]))
        frames.append(read_wide_series(spark, str(tmp_path / f"{at}.csv")))
    plain, stored = country_tracker(*frames), country_tracker(*frames, store=str(tmp_path / "store"))
    assert set(plain) == set(stored)
    for name, table in stored.items():
        assert table.columns == plain[name].columns and rows(table) == rows(plain[name]), name
        assert "csv" not in table._jdf.queryExecution().executedPlan().toString().lower()


def document(spark, confirmed, deaths):
    kind = "array<struct<fecha:string,dep:map<string,double>>>"
    return spark.createDataFrame([(confirmed, deaths)], f"confirmados {kind}, decesos {kind}")


def record(day, **values):
    counts = {name: 1.0 for name in DEPARTMENTS}
    counts.update({name.replace("_", " "): float(v) for name, v in values.items()})
    return (f"2020-03-{day:02d}", counts)


def test_department_curves(spark, rows):
    short = ("2020-03-01", {"Beni": 50.0})
    df = document(
        spark,
        [record(4, Beni=90), record(3, Beni=30), record(2, La_Paz=9, Beni=20), short],
        [record(5, Pando=70), record(4, Pando=60), record(3, Pando=40)],
    )
    latest = newest_record(df)
    out = department_curves(df, latest)
    got = [(e, str(d), n, day) for e, d, n, day in rows(out, "Dpto", "Fecha", "Count", "Day")]
    assert got == [
        ("Beni", "2020-03-01", 50.0, 1),
        ("Beni", "2020-03-02", 20.0, 2),
        ("Beni", "2020-03-03", 30.0, 3),
        ("Bolivia", "2020-03-02", 36.0, 1),
        ("Bolivia", "2020-03-03", 38.0, 2),
    ]
    # the newest date of the cases is left out of the deaths as well
    pando = department_curves(df, latest, "decesos").filter("Dpto = 'Pando'")
    assert sorted(r.Count for r in pando.collect()) == [40.0, 70.0]
    assert df.select(department_update_day(latest)).first()[0] == "03/03/20"
    assert spark.range(1).select(update_label("2020-03-04")).first()[0].endswith(":  04/03/2020")


def test_department_tracker_puts_the_total_first(spark):
    df = document(spark, [record(d, Beni=20 * d, Pando=11) for d in range(12, 1, -1)], [])
    tables = department_tracker(df)
    assert tables["encabezado"].first()[0] == "Última fecha de actualización:  11/03/2020"
    assert [r.Dpto for r in tables["duplicacion_confirmados"].collect()] == ["Bolivia", "Beni", "Pando"]
    ranks = {r.Dpto: r.Dpto_ord for r in tables["curvas_confirmados"].collect()}
    assert ranks == {"Beni": 10, "Bolivia": 9, "Pando": 4}  # seventh of ten names, from the end
    assert tables["curvas_decesos"].count() == 0


def test_education_panel(spark):
    data = [
        ("Bolivia", "Latin America", 2010, 25, 29, 10.0, 100.0),
        ("Bolivia", "Latin America", 2010, 30, 34, 20.0, 300.0),
        ("Bolivia", "Latin America", 2010, 35, 39, 99.0, 999.0),
        ("Bolivia", "Latin America", 2005, 25, 29, 99.0, 999.0),
        ("Peru", "Latin America", 2010, 25, 29, 30.0, 600.0),
        ("USA", "Advanced", 2010, 60, 64, 40.0, 50.0),
        ("Republic of Korea", "Advanced", 2010, 25, 29, 75.0, 10.0),
    ]
    df = spark.createDataFrame(
        data, "country string, region_code string, year int, agefrom int, ageto int, lhc double, pop double"
    )
    percent = "Porc.Completado.Edu.Terciaria"
    got = {(r.Region, r.Edad): (r[percent], r.drawn, r.Region_ord) for r in education_panel(df).collect()}
    assert got == {
        ("Bolivia", "25-34"): (17.5, 17.5, 3),
        ("Corea del Sur", "25-34"): (75.0, None, 5),
        ("EEUU", "55-64"): (40.0, 40.0, 4),
        ("LATAM", "25-34"): (25.0, 25.0, 2),
        ("Mundo", "25-34"): (25.5, 25.5, 1),
        ("Mundo", "55-64"): (40.0, 40.0, 1),
    }


SCORES = [
    ("Bolivia", "BOL", 2010, 6.0),
    ("South Korea", "KOR", 2010, 8.0),
    ("United States", "USA", 2010, 10.0),
    ("Peru", "PER", 2010, 7.0),
    ("Venezuela", "VEN", 2010, -20.0),
    ("World", None, 2010, 4.0),
    ("Peru", "PER", 2011, 3.0),
]


def codes(spark):
    return spark.createDataFrame([("BOL",), ("PER",), ("VEN",)], "code string")


def test_satisfaction_panel(spark):
    df = spark.createDataFrame(SCORES, "Entity string, Code string, Year int, Index double")
    out = satisfaction_panel(df, codes(spark))
    got = {(r.Region, r["Año"]): (r.Indice, r.RegionTipo, r.Region_ord) for r in out.collect()}
    assert got == {
        ("Bolivia", 2010): (6.0, "Bolivia", 1),
        ("Corea del Sur", 2010): (8.0, "Benchmark Paises", 2),
        ("EEUU", 2010): (10.0, "Benchmark Paises", 3),
        ("LATAM", 2010): (pytest.approx(-7 / 3), "Benchmark Regiones", 4),
        ("LATAM", 2011): (3.0, "Benchmark Regiones", 4),
        ("Mundo", 2010): (2.5, "Benchmark Regiones", 5),
        ("Mundo", 2011): (3.0, "Benchmark Regiones", 5),
    }
    labels = newest_labels(out, "Año", "Indice", 2).collect()
    assert {(r.Region, r["Año"], r.label) for r in labels} == {("LATAM", 2011, 3.0), ("Mundo", 2011, 3.0)}


def test_regime_panel_leaves_one_code_out_of_the_region(spark):
    df = spark.createDataFrame(SCORES, "Entity string, Code string, Year int, Score double")
    out = regime_panel(df, codes(spark))
    got = {(r.Region, r["Año"]): r.Puntuacion for r in out.collect()}
    assert got == {
        ("Bolivia", 2010): 6.0,
        ("Corea del Sur", 2010): 8.0,
        ("EEUU", 2010): 10.0,
        ("LATAM", 2010): 6.0,  # 6.5 to even
        ("LATAM", 2011): 3.0,
        ("Mundo", 2010): 2.0,  # 2.5 to even
        ("Mundo", 2011): 3.0,
    }


def test_gdp_panel_has_a_row_for_every_year_and_code(spark):
    data = [
        ("USA", 1950, 10.0, 5.0),
        ("BOL", 1950, 2.0, 1.0),
        ("PER", 1950, None, 3.0),
        ("USA", 1949, 1.0, 1.0),
        ("KOR", 1951, 3.0, 1.0),
    ]
    df = spark.createDataFrame(data, "countrycode string, year int, cgdppc double, pop double")
    got = {(r.Region, r["Año"]): r.value for r in gdp_panel(df, codes(spark)).collect()}
    assert got == {
        ("Bolivia", 1950): 0.2,
        ("Corea del Sur", 1950): None,
        ("LATAM", 1950): 0.05,
        ("Bolivia", 1951): None,
        ("Corea del Sur", 1951): None,
        ("LATAM", 1951): None,
    }


def test_stringency_overlay(spark, rows):
    cases = wide(spark, [(None, "Bolivia", [0, 1, 30]), (None, "US", [1, 2, 3]), (None, "Peru", [1, 1, 1])], 3)
    index = spark.createDataFrame(
        [
            ("Bolivia", "BOL", "2020-01-23", 40.0, 1.0),
            ("Bolivia", "BOL", "2020-01-24", 80.0, 100.0),
            ("United States", "USA", "2020-01-24", 20.0, None),
            ("Peru", "PER", "2020-01-24", 20.0, 10.0),
            ("Chad", "TCD", "2020-01-24", 20.0, 10.0),
        ],
        "Country string, iso3c string, Date string, StringencyIndex double, ConfirmedCases double",
    ).withColumn("Date", F.to_date("Date"))
    out = stringency_overlay(cases, index)
    assert rows(out, "Country", "Day", "count_drawn", "index_drawn", "Country_ord") == [
        ("Bolivia", 1, None, 2.0, 4),
        ("Bolivia", 2, 2.0, 4.0, 4),
    ]
