"""Ratios, rounding and medians, each with its own convention for empty input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round6(x: Column) -> Column:
    return F.round(x, 6)


def ratio1(a: Column, b: Column) -> Column:
    """a / b rounded to 6 places; 1.0 where b is 0."""
    return F.when(b == 0, F.lit(1.0)).otherwise(round6(a / b))


def optional_rate(a: Column, b: Column) -> Column:
    """a / b rounded to 6 places; null where b is 0."""
    return F.when(b > 0, round6(a / b))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def median0(x: Column) -> Column:
    """Aggregate: the median, 0.0 of nothing."""
    return F.coalesce(F.median(x), F.lit(0.0))


def median_positive(x: Column) -> Column:
    """Aggregate: the median of the finite positive values, null if there are none."""
    return F.median(F.when(finite(x) & (x > 0), x))


def dimension_score(weighted: Column, denominator: Column) -> Column:
    """100 minus the weighted findings per thousand characters, within 0 and 100."""
    rate = weighted * 1000 / denominator
    return round6(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 - rate)))


def glyph_width(advance: Column, units_per_em: Column) -> Column:
    """A whole advance in thousandths of an em, halves rounded up; null without an em."""
    units = F.when(units_per_em > 0, units_per_em).cast("bigint")
    sum_ = advance.cast("bigint") * 1000 + ((units - F.pmod(units, F.lit(2))) / 2).cast("bigint")
    return ((sum_ - F.pmod(sum_, units)) / units).cast("bigint")
