"""Cohort alignment, doubling times and benchmark panels on Spark DataFrames."""

__version__ = "0.1.0"
