"""Panels that set a focal country against peers, a region and the world."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.functions import (
    band_of,
    benchmark_class,
    clip_to_domain,
    column,
    first_match,
    half_even,
    level_rank,
    ratio,
    within_any_band,
)
from cohortline.functions.categories import benchmark_classes
from cohortline.operators.benchmark import (
    keep_members,
    members,
    region_and_world_mean,
    segment_rates,
    weighted_by_population,
    weighted_rate,
)
from cohortline.operators.latest import keep_latest
from cohortline.operators.reshape import melt, spread
from cohortline.operators.stacking import bind_rows
from cohortline.sources.csv_files import melt_years

# Names, patterns and bands of the published panels.
FOCAL = "Bolivia"
REGION = "LATAM"
WORLD = "Mundo"
REGION_NAME = "Latin America & Caribbean"
AGE_BANDS = {"25-34": [(25, 29), (30, 34)], "55-64": [(55, 59), (60, 64)]}
EDUCATION_RULES = [("korea", "Corea del Sur"), ("usa", "EEUU"), ("bolivia", FOCAL)]
EDUCATION_REGION_PATTERN = "latin"
EDUCATION_LEVELS = [WORLD, REGION, FOCAL, "EEUU", "Corea del Sur"]
CODE_RULES = [("bol", FOCAL), ("kor", "Corea del Sur"), ("usa", "EEUU")]
SATISFACTION_CODES = ["BOL", "USA", "KOR"]
REGIME_RULES = [
    ("south korea", "Corea del Sur"),
    ("united states", "EEUU"),
    ("bolivia", FOCAL),
]
REGIME_EXCLUDED = ["VEN"]
PANEL_LEVELS = [FOCAL, "Corea del Sur", "EEUU", REGION, WORLD]
GDP_CODES = ["USA", "BOL", "KOR"]
GDP_BASE = "USA"
GDP_FIRST_YEAR = 1950
GDP_LEVELS = [FOCAL, "Corea del Sur", REGION]
VACCINATION_RULES = [("^rep.*korea", "Corea del Sur"), ("united st", "EEUU"), ("bolivia", FOCAL)]
VACCINATION_REGIONS = ["Americas", "(WHO) Global"]
VACCINATION_LEVELS = [FOCAL, "Corea del Sur", "EEUU", "Americas", WORLD]
VACCINATION_YEARS = (1980, 2020)


def any_rule(text: str | Column, rules: Sequence[tuple[str, str]]) -> Column:
    """True where one of the patterns is found in the lower-cased text."""
    return F.lower(column(text)).rlike("|".join(pattern for pattern, _ in rules))


def label_rules(text: str | Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Label of the first matching rule; the last rule is the catch-all."""
    return first_match(text, rules[:-1], rules[-1][1])


def classed(
    panel: DataFrame,
    entity: str,
    class_to: str,
    focal: str,
    regions: Sequence[str],
    levels: Sequence[str],
) -> DataFrame:
    """Add the benchmark class and the display order of entity and class."""
    return (
        panel.withColumn(class_to, benchmark_class(entity, focal, regions))
        .withColumn(f"{entity}_ord", level_rank(entity, levels))
        .withColumn(f"{class_to}_ord", level_rank(class_to, benchmark_classes(focal)))
    )


def region_codes(dimension: DataFrame, region: str = REGION_NAME) -> DataFrame:
    """Country codes of a region."""
    return members(dimension, "Country Code", column("Region") == region)


def education_panel(
    survey: DataFrame,
    year: int = 2010,
    rules: Sequence[tuple[str, str]] = EDUCATION_RULES,
    region_pattern: str = EDUCATION_REGION_PATTERN,
    bands: Mapping[str, Sequence[tuple[int, int]]] = AGE_BANDS,
    levels: Sequence[str] = EDUCATION_LEVELS,
    digits: int = 1,
    limits: tuple[float, float] = (0, 70),
) -> DataFrame:
    """Tertiary completion of two age bands: countries, region and world, population-weighted.

    The year is filtered on the scan, before any grouping. The survey is read and reduced
    to segments once; each segment then counts for its country, its region and the world.
    """
    (young, young_bands), (old, old_bands) = bands.items()
    rows = survey.filter(F.col("year") == year).filter(
        within_any_band("agefrom", "ageto", [*young_bands, *old_bands])
    )
    rows = rows.withColumn("Edad", band_of("agefrom", "ageto", young_bands, young, old))
    percent = "Porc.Completado.Edu.Terciaria"

    segments = segment_rates(rows, ["country", "region_code", "Edad"], "pop", "lhc", "rate")
    groups = F.array_compact(
        F.array(
            F.when(any_rule("country", rules), label_rules("country", rules)),
            F.when(F.lower("region_code").rlike(region_pattern), F.lit(REGION)),
            F.lit(WORLD),
        )
    )
    members_of = segments.select(F.explode(groups).alias("Region"), "Edad", "pop", "rate")
    panel = weighted_rate(members_of, ["Region", "Edad"], "pop", "rate", percent)
    return (
        panel.withColumn(percent, half_even(percent, digits))
        .withColumn("drawn", clip_to_domain(percent, *limits))
        .withColumn("Region_ord", level_rank("Region", levels))
    )


def satisfaction_panel(
    scores: DataFrame,
    codes: DataFrame,
    countries: Sequence[str] = SATISFACTION_CODES,
    rules: Sequence[tuple[str, str]] = CODE_RULES,
) -> DataFrame:
    """Life satisfaction per year: countries, unweighted region mean and world mean.

    The world mean covers every row, aggregates and rows without a code included. Levels
    follow first appearance, the files being sorted by country.
    """
    selected = scores.filter(column("Code").isin(*countries)).select(
        label_rules("Code", rules).alias("Region"), "Year", "Index"
    )
    means = region_and_world_mean(
        scores, codes, "Code", "Year", "Index", "Region", (REGION, WORLD)
    )
    panel = bind_rows(selected, means, fill=True)
    return classed(
        panel, "Region", "RegionTipo", FOCAL, [REGION, WORLD], PANEL_LEVELS
    ).withColumnsRenamed({"Year": "Año", "Index": "Indice"})


def regime_panel(
    scores: DataFrame,
    codes: DataFrame,
    rules: Sequence[tuple[str, str]] = REGIME_RULES,
    excluded: Sequence[str] = REGIME_EXCLUDED,
) -> DataFrame:
    """Political-regime score per year: countries, region without the excluded codes, world.

    Means are rounded to whole scores; the code for "not sovereign" counts as a number.
    """
    selected = scores.filter(any_rule("Entity", rules)).select(
        label_rules("Entity", rules).alias("Entity"), "Year", "Score"
    )
    kept = members(codes, codes.columns[0], F.lit(True), exclude=excluded)
    means = region_and_world_mean(
        scores, kept, "Code", "Year", "Score", "Entity", (REGION, WORLD), digits=0
    )
    panel = bind_rows(selected, means).withColumnsRenamed(
        {"Entity": "Region", "Year": "Año", "Score": "Puntuacion"}
    )
    return classed(panel, "Region", "RegionType", FOCAL, [REGION, WORLD], PANEL_LEVELS)


def gdp_panel(
    series: DataFrame,
    codes: DataFrame,
    countries: Sequence[str] = GDP_CODES,
    base: str = GDP_BASE,
    first_year: int = GDP_FIRST_YEAR,
    rules: Sequence[tuple[str, str]] = CODE_RULES,
) -> DataFrame:
    """GDP per head relative to the base country: countries and weighted region mean.

    The few codes are spread to columns, so every year has a row for each of them, null
    where a value is missing.
    """
    recent = series.filter(F.col("year") >= first_year)
    selected = recent.filter(column("countrycode").isin(*countries)).select(
        "countrycode", "year", "cgdppc"
    )
    region = weighted_by_population(
        keep_members(recent, codes, "countrycode"), "year", "cgdppc", "pop"
    ).withColumn("countrycode", F.lit(REGION))
    codes_shown = [*countries, REGION]
    wide = spread(bind_rows(selected, region), ["year"], "countrycode", codes_shown, "cgdppc")
    relative = wide.select(
        F.col("year").alias("Año"),
        *[ratio(code, base).alias(code) for code in codes_shown if code != base],
    )
    panel = melt(relative, ["Año"], "code", "value").select(
        "Año",
        "value",
        half_even(F.col("value") * 100, 2).alias("percent"),
        first_match("code", rules, REGION).alias("Region"),
    )
    return classed(panel, "Region", "RegionTipo", FOCAL, [REGION], GDP_LEVELS)


def vaccination_panel(
    countries: DataFrame,
    regions: DataFrame,
    rules: Sequence[tuple[str, str]] = VACCINATION_RULES,
    kept_regions: Sequence[str] = VACCINATION_REGIONS,
    levels: Sequence[str] = VACCINATION_LEVELS,
    limits: tuple[int, int] = VACCINATION_YEARS,
) -> DataFrame:
    """Vaccination coverage per year from two wide tables: countries and regions.

    Rows are chosen before the reshape, so only the charted ones go long. ``drawn`` is the year within the
    limits of the axis, null outside them.
    """
    country_key, region_key = countries.columns[0], regions.columns[0]
    chosen = countries.filter(any_rule(country_key, rules)).withColumn(
        country_key, label_rules(country_key, rules)
    )
    by_country = melt_years(
        chosen.withColumnRenamed(country_key, "Region"), "Region", "Año", "value"
    )
    listed = regions.filter(column(region_key).isin(*kept_regions))
    named = first_match(region_key, [("who", WORLD)], column(region_key))
    by_region = melt_years(
        listed.withColumn(region_key, named).withColumnRenamed(region_key, "Region"),
        "Region",
        "Año",
        "value",
    )
    panel = bind_rows(by_country, by_region).withColumn("drawn", clip_to_domain("Año", *limits))
    regions_shown = [r for r in levels if r not in {label for _, label in rules}]
    return classed(panel, "Region", "RegionType", FOCAL, regions_shown, levels)


def newest_labels(panel: DataFrame, year: str, value: str, digits: int) -> DataFrame:
    """Rows of the newest year with the rounded value that labels the line."""
    return keep_latest(panel, year).withColumn("label", half_even(value, digits))
