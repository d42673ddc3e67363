"""Text tables whose files each have head lines of their own.

The head of a file is a few lines: they are read file by file, without a scan. The bodies of
all files are one scan of whole lines, each with its file, which large files are split for.
"""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: With a separator that no text holds and no quotes, a CSV reader gives whole lines.
WHOLE_LINES = {"header": True, "sep": "\u0001\u0002\u0003", "quote": "", "escape": ""}
#: Readers of heads at a time.
HEADS_AT_ONCE = 16
#: Characters of header names up to which Spark may broadcast them as it likes.
SMALL_HEADERS = 4_000_000


def file_heads(spark: SparkSession, path: str, count: int) -> dict[str, list[str]]:
    """The first lines of every file that has so many, by file, without a byte order mark."""

    def head(file: str) -> tuple[str, list[str]] | None:
        lines = spark.read.text(unquote(file)).select("_metadata.file_path", "value").head(count)
        return (lines[0][0], [line[1].lstrip("﻿") for line in lines]) if len(lines) == count else None

    with ThreadPoolExecutor(HEADS_AT_ONCE) as pool:
        found = list(pool.map(head, sorted(spark.read.text(path).inputFiles())))
    return dict(pair for pair in found if pair is not None)


def header_cells(line: str) -> list[str]:
    return next(csv.reader([line]), [])


def body_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, opens, line``: every line but the first of each file and blank ones.

    ``opens`` is true in the part of a file that holds its beginning.
    """
    lines = spark.read.schema("line string").options(**WHOLE_LINES).csv(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("opens"), "line"
    )


def csv_cells(line: Column) -> Column:
    """The cells of a line, quotes taken off, as an array; a quoted cell may hold commas and doubled quotes."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]++|"")*+"|[^,]*+)'), F.lit(1))

    def bare(cell: Column) -> Column:
        inside = F.substring(cell, F.lit(2), F.length(cell) - 2)
        return F.when(cell.startswith('"') & (F.length(cell) > 1), F.replace(inside, F.lit('""'), F.lit('"'))).otherwise(cell)

    return F.transform(cells, bare)


def named_lines(
    spark: SparkSession, path: str, heads: Mapping[str, Sequence[str]], names: Mapping[str, Sequence[str]]
) -> DataFrame:
    """``file, names, cells`` of every data line; ``names`` are those of the line's file.

    Lines that are, as a whole, one of their own file's further head lines are left out where the file begins.
    """
    rows = [(file, list(names[file]), list(head[1:])) for file, head in heads.items()]
    of_file = spark.createDataFrame(rows, "of string, names array<string>, head array<string>")
    if sum(map(len, (name for row in rows for name in row[1]))) > SMALL_HEADERS:
        of_file = of_file.hint("merge")
    lines = body_lines(spark, path).join(of_file, F.col("file") == F.col("of"))
    return lines.where(~(F.col("opens") & F.array_contains("head", F.col("line")))).select(
        "file", "names", csv_cells(F.col("line")).alias("cells")
    )


def named_cell(name: str) -> Column:
    """A line's cell below a header name, null where its file has none."""
    return F.get("cells", (F.array_position("names", F.lit(name)) - 1).cast("int"))
