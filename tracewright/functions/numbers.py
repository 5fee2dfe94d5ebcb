"""Rounded ratios of counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded_ratio(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    """numerator / denominator of whole numbers, rounded half up by whole-number arithmetic."""
    scale = 10**digits
    doubled = numerator * F.lit(2 * scale) + denominator
    return F.floor(doubled / (denominator * F.lit(2))).cast("double") / F.lit(float(scale))


def hundredths(numerator: Column, denominator: Column) -> Column:
    """The same to two digits as a whole number of hundredths, for exact means of rounded values."""
    return F.floor((numerator * F.lit(200) + denominator) / (denominator * F.lit(2))).cast("bigint")
