"""Scan of the policy-stringency export, whose 35 columns have fixed types.

The original spreadsheet form has no Spark reader; a CSV export with the same column
order is read instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from cohortline.functions import parse_yyyymmdd
from cohortline.sources.csv_files import MISSING

# Six measures of value, scope flag and note; five of value and note.
SCOPED_MEASURES = 6
PLAIN_MEASURES = 5


def export_schema() -> StructType:
    text, number = StringType(), DoubleType()
    fields = [
        StructField("CountryName", text),
        StructField("CountryCode", text),
        StructField("Date", number),
    ]
    for i in range(1, SCOPED_MEASURES + 1):
        fields += [
            StructField(f"S{i}", number),
            StructField(f"S{i}_IsGeneral", number),
            StructField(f"S{i}_Notes", text),
        ]
    for i in range(SCOPED_MEASURES + 1, SCOPED_MEASURES + PLAIN_MEASURES + 1):
        fields += [StructField(f"S{i}", number), StructField(f"S{i}_Notes", text)]
    fields += [
        StructField("ConfirmedCases", number),
        StructField("ConfirmedDeaths", number),
        StructField("StringencyIndex", number),
        StructField("_skipped", text),
    ]
    return StructType(fields)


def read_stringency(spark: SparkSession, path: str) -> DataFrame:
    """Country, code, date, index and cases; the other columns are never parsed."""
    reader = spark.read.option("header", True).option("nullValue", MISSING)
    raw = reader.schema(export_schema()).csv(path)
    return raw.select(
        F.col("CountryName").alias("Country"),
        F.col("CountryCode").alias("iso3c"),
        parse_yyyymmdd("Date").alias("Date"),
        "StringencyIndex",
        "ConfirmedCases",
    )
