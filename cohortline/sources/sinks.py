"""Writers for chart-ready and report-ready tables."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import DataFrame

from cohortline.functions import column


def save_chart_table(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write the long table as Parquet if a path is given; returns the table."""
    if path is not None:
        df.write.mode("overwrite").parquet(path)
    return df


def save_summary_table(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a small report table as CSV with a header if a path is given; returns the table."""
    if path is not None:
        df.write.mode("overwrite").option("header", True).csv(path)
    return df


def save_bucketed(
    df: DataFrame, table: str, entity: str, buckets: int, order: Sequence[str] = (), path: str | None = None
) -> DataFrame:
    """Write as a table of the catalog that is bucketed by entity, and sorted within; returns the table.

    What needs the rows of an entity together (cohorts, doubling times, joins on the entity with tables of as many
    buckets) then reads them without an exchange. ``path`` puts the files elsewhere than into the warehouse. Each
    bucket is one file: choose as many that a bucket fits a task.
    """
    writer = df.repartition(buckets, column(entity)).write.mode("overwrite").bucketBy(buckets, entity).sortBy(entity, *order)
    (writer if path is None else writer.option("path", path)).saveAsTable(table)
    return df.sparkSession.table(table)


def save_tables(
    tables: Mapping[str, DataFrame], folder: str | None = None, summaries: Collection[str] = ()
) -> None:
    """Write each named table below the folder, if one is given; ``summaries`` as CSV."""
    if folder is None:
        return
    for name, df in tables.items():
        save = save_summary_table if name in summaries else save_chart_table
        save(df, f"{folder.rstrip('/')}/{name}")
