"""Readers and writers."""

from cohortline.sources.csv_files import (
    header_names,
    melt_years,
    read_series,
    read_table,
    read_titled,
    read_wide_series,
)
from cohortline.sources.json_files import read_departments
from cohortline.sources.sinks import save_bucketed, save_chart_table, save_summary_table, save_tables
from cohortline.sources.typed_scan import export_schema, read_stringency

__all__ = [
    "export_schema",
    "header_names",
    "melt_years",
    "read_departments",
    "read_series",
    "read_stringency",
    "read_table",
    "read_titled",
    "read_wide_series",
    "save_bucketed",
    "save_chart_table",
    "save_summary_table",
    "save_tables",
]
