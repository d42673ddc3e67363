"""Policy stringency against the case curve of the same country."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from cohortline.functions import column, level_rank, recode
from cohortline.operators.overlay import two_scales
from cohortline.plans.tracker import country_curves

# Name matches, shown countries in facet order and their printed names.
SERIES_NAMES = {"Korea, South": "South Korea", "US": "United States"}
SHOWN = ["South Korea", "Italy", "United States", "Bolivia", "Brazil", "Ecuador"]
PRINTED_NAMES = {
    "Brazil": "Brasil",
    "United States": "Estados Unidos",
    "South Korea": "Corea del Sur",
    "Italy": "Italia",
}


def stringency_overlay(
    confirmed_wide: DataFrame,
    stringency: DataFrame,
    shown: Sequence[str] = SHOWN,
    printed: Mapping[str, str] = PRINTED_NAMES,
    threshold: float = 1,
) -> DataFrame:
    """Index and cases per country and day since the first case; unmatched rows drop out."""
    curves = country_curves(confirmed_wide, threshold, SERIES_NAMES, keep_date=True)
    return joined_overlay(curves, stringency, shown, printed)


def joined_overlay(
    curves: DataFrame, stringency: DataFrame, shown: Sequence[str], printed: Mapping[str, str]
) -> DataFrame:
    """Join curves and index on (Country, Date) and prepare both for one day axis."""
    wanted = column("Country").isin(*shown)
    joined = stringency.filter(wanted).join(curves.filter(wanted), ["Country", "Date"], "inner")
    drawn = two_scales(joined, "ConfirmedCases", "StringencyIndex")
    return drawn.withColumn("Country_ord", level_rank("Country", shown)).withColumn(
        "Country", recode("Country", printed)
    )
