"""Text expressions and column lookup by arbitrary name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(col: str | Column) -> Column:
    """Column by exact name; names such as ``1/22/20`` or ``a.b`` need no quoting by the caller."""
    if isinstance(col, Column):
        return col
    return F.col("`" + col.replace("`", "``") + "`")


def paste(*parts: str | Column, sep: str = " ") -> Column:
    """Join column values with a separator; a missing value becomes the text ``NA``.

    Strings name columns; wrap literal text in ``F.lit``.
    """
    return F.concat_ws(sep, *[F.coalesce(column(p).cast("string"), F.lit("NA")) for p in parts])


def template(text: str, *parts: str | Column) -> Column:
    """Text with a ``%s`` for each part; a missing value shows as ``NA``."""
    shown = [F.coalesce(column(p).cast("string"), F.lit("NA")) for p in parts]
    return F.format_string(text, *shown)


def thousands(col: str | Column) -> Column:
    """Whole number with comma separators; ``NA`` when missing."""
    return F.coalesce(F.format_number(column(col), 0), F.lit("NA"))


def blank_if(col: str | Column, value: str) -> Column:
    """Null where the text equals ``value``."""
    return F.nullif(column(col), F.lit(value))


def fill_blank(col: str | Column, value: str) -> Column:
    """``value`` where the text is null."""
    return F.coalesce(column(col), F.lit(value))


def swap(col: str | Column, old: str, new: str) -> Column:
    """``new`` where the text equals ``old``, everything else unchanged."""
    c = column(col)
    return F.when(c == old, F.lit(new)).otherwise(c)


def to_year(col: str | Column) -> Column:
    """Year column name (``2017``, `` 2017``, ``X2017``, ``X.2017``) to an integer; null if it holds none."""
    return F.regexp_extract(F.trim(column(col)), r"^(?:X\.?)?(\d+)$", 1).try_cast("int")
