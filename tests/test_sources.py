"""Readers and writers on small hand-made files."""

import json
from datetime import date

import pytest

from cohortline.functions import column, parse_mdy
from cohortline.operators.cohort import align_since_threshold
from cohortline.operators.doubling import doubling_table
from cohortline.operators.latest import newest_snapshot
from cohortline.plans.panels import REGION_NAME, region_codes, vaccination_panel
from cohortline.plans.tracker import snapshot_curves
from cohortline.session import SCRATCH_SETTING, scratch_path
from cohortline.sources import (
    export_schema,
    read_departments,
    read_series,
    read_stringency,
    read_table,
    read_titled,
    read_wide_series,
    save_bucketed,
    save_chart_table,
    save_summary_table,
    save_tables,
)
from cohortline.sources.csv_files import COUNTRY_DIMENSION, GDP, SATISFACTION


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_wide_series(spark, tmp_path, rows):
    path = write(
        tmp_path / "wide.csv",
        "Province/State,Country/Region,Lat,Long,1/22/20,1/23/20\n"
        ',Bolivia,-16.3,-63.6,1,NA\n"Hong Kong",China,22.3,114.2,,5\n',
    )
    df = read_wide_series(spark, path)
    assert dict(df.dtypes)["1/23/20"] == "double" and dict(df.dtypes)["Lat"] == "double"
    assert rows(df, "Province/State", "Country/Region", "1/22/20", "1/23/20") == [
        ("Hong Kong", "China", None, 5.0),
        (None, "Bolivia", 1.0, None),
    ]


def test_byte_order_mark_is_not_part_of_the_first_name(spark, tmp_path, rows):
    path = write(
        tmp_path / "dim.csv",
        f"﻿Country Code,Short Name,Region\nBOL,Bolivia,{REGION_NAME}\nBOL,again,{REGION_NAME}\nUSA,US,North\n",
    )
    dimension = read_table(spark, path, COUNTRY_DIMENSION)
    assert dimension.columns == ["Country Code", "Region"]
    assert rows(region_codes(dimension)) == [("BOL",)]


def test_columns_by_header_or_by_position(spark, tmp_path, rows):
    path = write(tmp_path / "gdp.csv", "year,pop,countrycode,extra,cgdppc\n2000,NA,BOL,x,1.5\n2001,3,USA,y,\n")
    assert rows(read_table(spark, path, GDP)) == [("BOL", 2000, 1.5, None), ("USA", 2001, None, 3.0)]
    named = write(tmp_path / "sat.csv", "Land,Kürzel,Jahr,Wert\nBolivia,BOL,2010,5.5\nWorld,,2010,5.1\n")
    assert rows(read_table(spark, named, SATISFACTION, by_position=True)) == [
        ("Bolivia", "BOL", 2010, 5.5),
        ("World", None, 2010, 5.1),
    ]


COUNTRIES = """,Coverage (%),Coverage (%),Coverage (%)
Country,2017,2016,1980
Bolivia (Plurinational State of),84,83,11
Republic of Korea,98,98,
Democratic People's Republic of Korea,97,96,55
United States of America,95,95,96
Peru,83,89,16
"""
REGIONS = '''"","Coverage (%)","Coverage (%)","Coverage (%)"
"WHO region"," 2017"," 2016"," 1980"
"Africa","72","72","5"
"Americas","91","91","50"
"(WHO) Global","85","85","21"
'''


def test_titled_tables_and_their_panel(spark, tmp_path, rows):
    countries = read_titled(spark, write(tmp_path / "c.csv", COUNTRIES), "Country")
    regions = read_titled(spark, write(tmp_path / "r.csv", REGIONS), "WHO region")
    assert countries.columns == ["Country", "2017", "2016", "1980"] and countries.count() == 5
    assert regions.columns == ["WHO region", " 2017", " 2016", " 1980"] and regions.count() == 3
    panel = vaccination_panel(countries, regions)
    got = {(r.Region, r["Año"]): (r.value, r.RegionType, r.Region_ord, r.RegionType_ord) for r in panel.collect()}
    assert len(got) == 15
    assert got["Bolivia", 2017] == (84, "Bolivia", 1, 1)
    assert got["Corea del Sur", 1980] == (None, "Benchmark Paises", 2, 2)
    assert got["Corea del Sur", 2016] == (98, "Benchmark Paises", 2, 2)
    assert got["EEUU", 1980] == (96, "Benchmark Paises", 3, 2)
    assert got["Americas", 2016] == (91, "Benchmark Regiones", 4, 3)
    assert got["Mundo", 1980] == (21, "Benchmark Regiones", 5, 3)


def test_titled_table_keeps_every_data_row(spark, tmp_path, rows):
    text = "Report on coverage,,\n,Coverage,Coverage\nCountry,2017,2016\nA,1,2\n,3,4\nCountry,5,\n"
    got = read_titled(spark, write(tmp_path / "t.csv", text), "Country", skip=2)
    assert got.columns == ["Country", "2017", "2016"]
    assert rows(got) == sorted([("A", 1, 2), (None, 3, 4), ("Country", 5, None)], key=repr)


def test_files_with_other_headers_are_an_error(spark, tmp_path):
    folder = tmp_path / "wide"
    folder.mkdir()
    write(folder / "a.csv", "Province/State,Country/Region,Lat,Long,1/1/20,1/2/20\n,A,1,1,1,2\n")
    write(folder / "b.csv", "Province/State,Country/Region,Lat,Long,1/2/20,1/1/20\n,B,1,1,2,1\n")
    with pytest.raises(Exception, match="header|Header"):
        read_wide_series(spark, str(folder)).collect()


def snapshots(folder):
    folder.mkdir()
    write(
        folder / "day 1.csv",
        "Province/State,Country/Region,Lat,Long,1/1/20,1/2/20\n,Alpha,1,1,5,6\nNorth,Beta,2,2,1,NA\n",
    )
    write(
        folder / "day 2.csv",
        '\ufeffLong,Country/Region,1/3/20,Province/State,1/2/20,1/4/20\n1,"Gamma, ""South""",7,,8,9\n2,Beta,3,North,2,\n\n1,Alpha,x,,16\n',
    )
    write(folder / "day 3.csv", "")
    write(folder / "day 4.csv", "Country/Region,Province/State,1/5/20\nBeta,North,30\n")
    return str(folder)


def test_series_of_files_with_other_dates(spark, tmp_path, rows):
    long = read_series(spark, snapshots(tmp_path / "wide"))
    assert rows(long, "Province/State", "Country/Region", "Lat", "Long", "Date", "Count", "Snapshot") == sorted(
        [
            (None, "Alpha", 1.0, 1.0, "1/1/20", 5.0, "1/2/20"),
            (None, "Alpha", 1.0, 1.0, "1/2/20", 6.0, "1/2/20"),
            ("North", "Beta", 2.0, 2.0, "1/1/20", 1.0, "1/2/20"),
            ("North", "Beta", 2.0, 2.0, "1/2/20", None, "1/2/20"),
            (None, 'Gamma, "South"', None, 1.0, "1/3/20", 7.0, "1/4/20"),
            (None, 'Gamma, "South"', None, 1.0, "1/2/20", 8.0, "1/4/20"),
            (None, 'Gamma, "South"', None, 1.0, "1/4/20", 9.0, "1/4/20"),
            ("North", "Beta", None, 2.0, "1/3/20", 3.0, "1/4/20"),
            ("North", "Beta", None, 2.0, "1/2/20", 2.0, "1/4/20"),
            ("North", "Beta", None, 2.0, "1/4/20", None, "1/4/20"),
            (None, "Alpha", None, 1.0, "1/3/20", None, "1/4/20"),
            (None, "Alpha", None, 1.0, "1/2/20", 16.0, "1/4/20"),
            (None, "Alpha", None, 1.0, "1/4/20", None, "1/4/20"),
            ("North", "Beta", None, None, "1/5/20", 30.0, "1/5/20"),
        ],
        key=repr,
    )


def test_newest_snapshot_counts(spark, tmp_path, rows):
    long = read_series(spark, snapshots(tmp_path / "wide"))
    found = newest_snapshot(long, ["Province/State", "Country/Region"], "Date", "Count", parse_mdy("Snapshot"))
    got = {(r[1], r.Date): r.Count for r in found.collect()}
    assert len(got) == 12
    assert (got["Alpha", "1/1/20"], got["Alpha", "1/2/20"], got["Beta", "1/2/20"], got["Beta", "1/5/20"]) == (5, 16, 2, 30)
    curves = snapshot_curves(long, threshold=1, names={}, promoted=["North"])
    assert rows(curves.select("Country", "Count", "Day", "NumDays")) == [
        ("North", 1.0, 1, 4), ("North", 2.0, 2, 4), ("North", 3.0, 3, 4), ("North", 30.0, 4, 4)
    ]
    curves.collect()
    executed = curves._jdf.queryExecution().executedPlan().toString()
    final = executed.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final or "ReusedQueryStage" in final, executed


def test_many_headers_are_one_scan(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for day in range(1, 29):
        names = [f"1/{d}/20" for d in range(day, day + 3)]
        write(folder / f"{day}.csv", ",".join(["Country/Region", *names]) + "\nAlpha," + ",".join(str(d) for d in range(day, day + 3)) + "\n")
    long = read_series(spark, str(folder))
    assert long._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    found = newest_snapshot(long, ["Country/Region"], "Date", "Count", parse_mdy("Snapshot"))
    assert {r.Date: r.Count for r in found.collect()} == {f"1/{d}/20": d for d in range(1, 31)}


def test_titled_files_with_other_titles_and_columns(spark, tmp_path, rows):
    folder = tmp_path / "titled"
    folder.mkdir()
    write(folder / "a.csv", "Title A,,\nCountry,2017,2016\nX,1,2\nTitle B,3,4\n")
    write(folder / "b.csv", '\ufeff"Title B",\n2015,Country,2016,2017\n9,Y,8," 7"\nNA,Title A,abc\n\n2017,Z,2016,Country\n')
    got = read_titled(spark, str(folder), "Country")
    assert got.columns == ["Country", "2017", "2016", "2015"]
    assert rows(got) == sorted(
        [("X", 1, 2, None), ("Title B", 3, 4, None), ("Y", 7, 8, 9), ("Title A", None, None, None), ("Z", None, 2016, 2017)], key=repr
    )


def test_head_lines_are_left_out_where_a_file_begins_only(spark, tmp_path, rows):
    path = write(tmp_path / "long.csv", "Title,\nCountry,2017\n" + "Country,1\nTitle,\n" * 3)
    assert rows(read_titled(spark, path, "Country")) == sorted([("Country", 1), ("Title", None)] * 3, key=repr)


def test_typed_export(spark, tmp_path, rows):
    names = [f.name for f in export_schema()]
    assert len(names) == 35
    cells = {n: "" for n in names}
    cells.update(CountryName="Bolivia", CountryCode="BOL", Date="20200322", StringencyIndex="81.5", ConfirmedCases="27", S1_Notes='"a, note"')
    text = ",".join(names) + "\n" + ",".join(cells[n] for n in names) + "\n"
    df = read_stringency(spark, write(tmp_path / "index.csv", text))
    assert rows(df) == [("Bolivia", "BOL", date(2020, 3, 22), 81.5, 27.0)]


def test_nested_documents(spark, tmp_path):
    document = {"confirmados": [{"fecha": "2020-03-02", "dep": {"La Paz": 3}}], "decesos": []}
    path = write(tmp_path / "data.json", json.dumps(document, indent=2))
    row = read_departments(spark, path).first()
    assert row.confirmados[0].fecha == "2020-03-02" and row.confirmados[0].dep == {"La Paz": 3.0}
    lines = write(tmp_path / "lines.json", json.dumps(document) + "\n" + json.dumps(document) + "\n")
    assert read_departments(spark, lines, one_document=False).count() == 2


def test_sinks_write_only_with_a_path(spark, tmp_path, rows):
    df = spark.createDataFrame([("Bolivia", "7 días")], "`País` string, `Última Semana` string")
    assert save_chart_table(df) is df and save_summary_table(df) is df
    save_chart_table(df, str(tmp_path / "chart"))
    save_chart_table(df, str(tmp_path / "chart"))
    save_summary_table(df, str(tmp_path / "table"))
    assert rows(spark.read.parquet(str(tmp_path / "chart"))) == [("Bolivia", "7 días")]
    back = spark.read.option("header", True).csv(str(tmp_path / "table"))
    save_tables({"a": df, "b": df}, None)
    save_tables({"a": df, "b": df}, str(tmp_path / "all"), summaries=["b"])
    assert spark.read.parquet(str(tmp_path / "all" / "a")).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "all" / "b")).count() == 1
    assert back.columns == df.columns and rows(back.select(column("País"))) == [("Bolivia",)]


def test_bucketed_tables_need_no_exchange(spark, tmp_path, rows):
    days = spark.range(4000).selectExpr("id % 40 AS place", "CAST(id DIV 40 AS int) AS day", "CAST(id AS double) AS n")
    names = spark.range(40).selectExpr("id AS place", "CAST(id AS string) AS name")
    stored = save_bucketed(days, "bucketed_days", "place", 4, ["day"], str(tmp_path / "days"))
    stored = save_bucketed(days, "bucketed_days", "place", 4, ["day"], str(tmp_path / "days"))
    other = save_bucketed(names, "bucketed_names", "place", 4, path=str(tmp_path / "names"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        aligned = align_since_threshold(stored, "place", "day", "n", 50).join(other, "place")
        table = doubling_table(aligned, "place", "n")
        for df in (aligned, table):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        plain = align_since_threshold(days, "place", "day", "n", 50).join(names, "place")
        assert rows(aligned) == rows(plain) and rows(table) == rows(doubling_table(plain, "place", "n"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_days")
        spark.sql("DROP TABLE bucketed_names")


def test_scratch_folder_follows_the_session(spark):
    class Conf:
        def __init__(self, **settings):
            self.settings = settings

        def get(self, key, default=None):
            return self.settings.get(key, default)

    class Session:
        def __init__(self, settings):
            self.conf = Conf(**settings)

    shared = Session({SCRATCH_SETTING: "hdfs://shared/tmp/", "spark.master": "yarn"})
    assert scratch_path(shared, "x").startswith("hdfs://shared/tmp/x-")
    with pytest.raises(ValueError):
        scratch_path(Session({"spark.master": "yarn"}), "x")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
