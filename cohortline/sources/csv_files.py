"""CSV readers. Schemas are given or read off the header line; no reader scans data to infer types.

All readers split large files across tasks, except for fields that contain line breaks,
which none of the inputs have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from cohortline.functions import column, to_year
from cohortline.operators.reshape import melt
from cohortline.sources.line_files import file_heads, header_cells, named_cell, named_lines

# Fixed value: text of a missing cell, beside the empty one.
MISSING = "NA"

# The leading columns of a wide case series.
SERIES_IDS = StructType(
    [
        StructField("Province/State", StringType()),
        StructField("Country/Region", StringType()),
        StructField("Lat", DoubleType()),
        StructField("Long", DoubleType()),
    ]
)

COUNTRY_DIMENSION = StructType(
    [StructField("Country Code", StringType()), StructField("Region", StringType())]
)
EDUCATION = (
    "country string, region_code string, year int, agefrom int, ageto int, lhc double, pop double"
)
SATISFACTION = "Entity string, Code string, Year int, Index double"
REGIME = "Entity string, Code string, Year int, Score double"
GDP = "countrycode string, year int, cgdppc double, pop double"


def header_names(spark: SparkSession, path: str) -> list[str]:
    """Column names on the header line; a byte order mark is not part of the first name."""
    return spark.read.option("header", True).csv(path).columns


def read_table(
    spark: SparkSession, path: str, schema: StructType | str, by_position: bool = False
) -> DataFrame:
    """CSV with a header line.

    Columns are found by their header name, in any order and among others that the schema
    does not list. ``by_position`` ignores the header text and names the columns in order.
    The files of a folder must share one header; another order of columns is an error.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    reader = spark.read.option("header", True).option("nullValue", MISSING)
    if by_position:
        return reader.schema(schema).csv(path)
    wanted = {f.name: f for f in schema.fields}
    found = [
        wanted.get(name, StructField(name, StringType())) for name in header_names(spark, path)
    ]
    reader = reader.option("enforceSchema", False)
    return reader.schema(StructType(found)).csv(path).select(
        [column(f.name) for f in schema.fields]
    )


def read_wide_series(
    spark: SparkSession, path: str, ids: StructType = SERIES_IDS
) -> DataFrame:
    """One row per place and one column per date: typed ids, every other column a double.

    The files of a folder must share one header; other dates, or in another order, are an error
    (:func:`read_series` reads them).
    """
    id_fields = {f.name: f for f in ids.fields}
    fields = [
        id_fields.get(name, StructField(name, DoubleType())) for name in header_names(spark, path)
    ]
    reader = spark.read.option("header", True).option("nullValue", MISSING).option("enforceSchema", False)
    return reader.schema(StructType(fields)).csv(path)


def present(cell: Column) -> Column:
    """A cell without blanks around it, null where it is empty or marks a missing value."""
    bare = F.trim(cell)
    return F.when(~bare.isin("", MISSING), bare)


def read_series(
    spark: SparkSession,
    path: str,
    ids: StructType = SERIES_IDS,
    date_to: str = "Date",
    count_to: str = "Count",
    snapshot_to: str = "Snapshot",
) -> DataFrame:
    """Wide series in long form, from files that each have columns of their own.

    A row per place, date column and file: typed ids, the column's name, its value, and the name of
    the file's last column, by which snapshots taken on different days can be told apart
    (:func:`~cohortline.operators.latest.newest_snapshot`). Each line is matched with the header of its
    own file, by name: dates may be shifted, missing or in another order, and an id that a file does not
    have is null. There is no schema of all columns, and the files are one scan however many headers
    there are. Cells that are no number are null, as are missing ones; empty files give nothing.
    """
    heads = file_heads(spark, path, 1)
    lines = named_lines(spark, path, heads, {file: header_cells(head[0]) for file, head in heads.items()})
    typed = [
        (named_cell(f.name) if isinstance(f.dataType, StringType) else present(named_cell(f.name)).try_cast(f.dataType))
        for f in ids.fields
    ]
    typed = [F.nullif(c, F.lit("")) if isinstance(f.dataType, StringType) else c for c, f in zip(typed, ids.fields)]
    cells = F.filter(
        F.arrays_zip("names", "cells"), lambda c: c["names"].isNotNull() & ~c["names"].isin(*ids.fieldNames())
    )
    long = lines.select(
        *[c.alias(f.name) for c, f in zip(typed, ids.fields)],
        F.element_at("names", -1).alias(snapshot_to),
        F.explode(cells).alias("_cell"),
    )
    return long.select(
        *[column(f.name) for f in ids.fields],
        F.col("_cell.names").alias(date_to),
        present(F.col("_cell.cells")).try_cast("double").alias(count_to),
        column(snapshot_to),
    )


def read_titled(
    spark: SparkSession, path: str, key: str, names: Sequence[str] | None = None, skip: int = 1
) -> DataFrame:
    """CSV with ``skip`` title lines above the header: a text key and integer columns.

    Every file has titles, columns and an order of columns of its own; its header is the line below
    its titles, unless ``names`` lists the columns of all files. Values go by name: the table has the
    key, which is the column of that name or else the first one, and every other column of any file, in the
    order in which they first occur (files by name); a file without a column gives null there. Rows with an empty key stay,
    cells that are no number are null. Large files are split. Titles and header are left out where a file
    begins, and nothing else is, except for a line there that repeats the whole header.
    """
    heads = file_heads(spark, path, skip + 1)
    headers = {file: list(names) if names is not None else header_cells(head[skip]) for file, head in heads.items()}
    keys = {file: key if key in header else header[0] for file, header in headers.items()}
    renamed = {file: [key if n == keys[file] else n for n in header] for file, header in headers.items()}
    measures = list(dict.fromkeys(n for header in renamed.values() for n in header if n != key))
    lines = named_lines(spark, path, heads, renamed)
    return lines.select(
        F.nullif(named_cell(key), F.lit("")).alias(key),
        *[present(named_cell(n)).try_cast("int").alias(n) for n in measures],
    )


def melt_years(wide: DataFrame, key: str, year_to: str, value_to: str) -> DataFrame:
    """Year columns to rows, with the column name as an integer year."""
    return melt(wide, [key], year_to, value_to).withColumn(year_to, to_year(F.col(year_to)))
