"""Numeric expressions: rounding, logarithms, ratios and the doubling formulas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortline.functions.text import column


def half_even(col: str | Column, digits: int = 0) -> Column:
    """Round with ties going to the even neighbour.

    To decimals, the nearer of the two neighbouring decimal numbers, as they are held in binary, is taken, and the
    even one only where they are equally near: 0.15 gives 0.1, although it is printed as a tie.
    """
    if digits <= 0:
        return F.bround(column(col), digits)
    c, power = column(col).cast("double"), float(10**digits)
    low, high = F.floor(c * power).cast("double") / power, F.ceil(c * power).cast("double") / power
    even = F.pmod(F.floor(c * power), F.lit(2)) == 0
    nearer = F.when((c - low < high - c) | ((c - low == high - c) & even), low).otherwise(high)
    # beyond 2^53 there is nothing to round; infinities and NaN stay
    return F.when(F.abs(c) < F.lit(2.0**53 / power), nearer).otherwise(c)


def log10_ieee(col: str | Column) -> Column:
    """Base-10 logarithm that gives -Infinity for 0 and NaN for negatives instead of null."""
    c = column(col).cast("double")
    return (
        F.when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan"))).otherwise(F.log10(c))
    )


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """Quotient as a double; by 0 an infinity of the numerator's sign, or NaN for 0 by 0, and never an error."""
    n, d = column(numerator).cast("double"), column(denominator).cast("double")
    infinite = F.when(n > 0, F.lit(float("inf"))).when(n < 0, F.lit(float("-inf")))
    by_zero = F.when((n == 0) | F.isnan(n), F.lit(float("nan"))).otherwise(infinite)
    return F.when(d == 0, by_zero).otherwise(F.try_divide(n, d))


def clip_to_domain(col: str | Column, low: float | Column, high: float | Column) -> Column:
    """Null outside ``[low, high]``; the row itself stays."""
    c = column(col)
    return F.when(c.between(low, high), c)


def within_any_band(
    low: str | Column, high: str | Column, bands: Sequence[tuple[int, int]]
) -> Column:
    """True where (low, high) is exactly one of the listed bands."""
    lo, hi = column(low), column(high)
    hit = F.lit(False)
    for band_low, band_high in bands:
        hit = hit | ((lo == band_low) & (hi == band_high))
    return hit


def doubling_growth(start: float | Column, rate: str | Column, elapsed: str | Column) -> Column:
    """Value after ``elapsed`` days of a series that starts at ``start`` and doubles every ``rate`` days."""
    start = start if isinstance(start, Column) else F.lit(float(start))
    exponent = column(elapsed).cast("double") / column(rate).cast("double")
    return half_even(start * F.pow(F.lit(2.0), exponent))


def doubling_days(first: str | Column, last: str | Column, interval: int) -> Column:
    """Whole days a series needs to double, given its value at both ends of ``interval`` days.

    Negative when the series falls and null when an end is missing. The two ends must
    differ; a zero at one end is the limit 0.
    """
    a, b = column(first).cast("double"), column(last).cast("double")
    exact = F.try_divide(
        F.lit(float(interval)) * F.log(F.lit(2.0)), F.log(F.try_divide(b, F.nullif(a, F.lit(0.0))))
    )
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(half_even(exact))
