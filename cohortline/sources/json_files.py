"""Nested department records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RECORDS = "array<struct<fecha:string,dep:map<string,double>>>"
DOCUMENT = f"confirmados {RECORDS}, decesos {RECORDS}"


def read_departments(spark: SparkSession, path: str, one_document: bool = True) -> DataFrame:
    """Documents with the arrays ``confirmados`` and ``decesos``, newest record first.

    ``one_document`` reads a pretty-printed file as one document, as the public feed
    publishes it; without it each line is a document and files are split.
    """
    return spark.read.schema(DOCUMENT).option("multiLine", one_document).json(path)
