"""Column expressions shared by the operators; every one is a native Spark expression."""

from cohortline.functions.aggregates import horizontal_sum, strict_mean, strict_sum, sum_or_zero
from cohortline.functions.categories import (
    band_of,
    benchmark_class,
    first_match,
    level_rank,
    locale_key,
    promote,
    recode,
    reversed_level_rank,
)
from cohortline.functions.dates import day_before, dmy, parse_iso, parse_mdy, parse_yyyymmdd
from cohortline.functions.numeric import (
    clip_to_domain,
    doubling_days,
    doubling_growth,
    half_even,
    log10_ieee,
    ratio,
    within_any_band,
)
from cohortline.functions.text import (
    blank_if,
    column,
    fill_blank,
    paste,
    swap,
    template,
    thousands,
    to_year,
)

__all__ = [
    "band_of",
    "benchmark_class",
    "blank_if",
    "clip_to_domain",
    "column",
    "day_before",
    "dmy",
    "doubling_days",
    "doubling_growth",
    "fill_blank",
    "first_match",
    "half_even",
    "horizontal_sum",
    "level_rank",
    "locale_key",
    "log10_ieee",
    "parse_iso",
    "parse_mdy",
    "parse_yyyymmdd",
    "paste",
    "promote",
    "ratio",
    "recode",
    "reversed_level_rank",
    "strict_mean",
    "strict_sum",
    "sum_or_zero",
    "swap",
    "template",
    "thousands",
    "to_year",
    "within_any_band",
]
