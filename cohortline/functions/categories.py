"""Category mapping: recodes, regex classes, bands and level order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortline.functions.numeric import within_any_band
from cohortline.functions.text import column

# Class labels of a benchmark panel.
PEER_CLASS = "Benchmark Paises"
REGION_CLASS = "Benchmark Regiones"


def recode(col: str | Column, mapping: Mapping[str, str]) -> Column:
    """Replace by lookup; a value without an entry stays as it is."""
    c = column(col)
    if not mapping:
        return c
    lookup = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(lookup, c), c)


def promote(province: str | Column, entity: str | Column, names: Sequence[str]) -> Column:
    """Entity name, except that the listed provinces count as entities of their own."""
    p = column(province)
    return F.when(p.isin(*names), p).otherwise(column(entity))


def first_match(
    col: str | Column, rules: Sequence[tuple[str, str]], otherwise: str | Column
) -> Column:
    """Label of the first (pattern, label) whose regex is found in the lower-cased text."""
    text = F.lower(column(col))
    result = None
    for pattern, label in rules:
        hit = text.rlike(pattern)
        result = F.when(hit, F.lit(label)) if result is None else result.when(hit, F.lit(label))
    fallback = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return fallback if result is None else result.otherwise(fallback)


def benchmark_class(col: str | Column, focal: str, regions: Sequence[str]) -> Column:
    """The focal entity itself, a benchmark region, or (everything else) a benchmark peer."""
    c = column(col)
    return (
        F.when(c == focal, F.lit(focal))
        .when(c.isin(*regions), F.lit(REGION_CLASS))
        .when(c.isNotNull(), F.lit(PEER_CLASS))
    )


def benchmark_classes(focal: str) -> list[str]:
    """Level order of :func:`benchmark_class`."""
    return [focal, PEER_CLASS, REGION_CLASS]


def band_of(
    low: str | Column,
    high: str | Column,
    bands: Sequence[tuple[int, int]],
    label: str,
    otherwise: str,
) -> Column:
    """``label`` where (low, high) is one of ``bands``, ``otherwise`` elsewhere."""
    return F.when(within_any_band(low, high, bands), F.lit(label)).otherwise(F.lit(otherwise))


def level_rank(col: str | Column, levels: Sequence[str]) -> Column:
    """1-based position of the value in an explicit level list; null for an unlisted value."""
    listed = F.array(*[F.lit(v) for v in levels])
    return F.nullif(F.array_position(listed, column(col)), F.lit(0).cast("bigint"))


def locale_key(col: str | Column, locale: str = "UNICODE_CI_AI") -> Column:
    """The text under a collation: it then sorts and compares as readers expect, not by code points.

    The default takes letters of all languages, and neither case nor accents tell names apart. A language's own
    order, such as ``es``, in which ñ follows n, and case or accents that count are other collations.
    """
    return F.collate(column(col), locale)


def reversed_level_rank(col: str | Column, levels: Sequence[str]) -> Column:
    """1-based position counted from the end of the level list."""
    return F.lit(len(levels) + 1).cast("bigint") - level_rank(col, levels)
