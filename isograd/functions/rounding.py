"""Rounding to significant digits as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _extra_digits(value: Column) -> Column:
    """Digits to add so that leading zeros after the point do not count; never negative."""
    zeros = -F.floor(F.log10(F.abs(value)))
    return F.when(value == 0, F.lit(323)).otherwise(F.greatest(zeros, F.lit(0))).cast("int")


def _round_at(value: Column, digits: Column) -> Column:
    # past 15 digits a double holds nothing to round
    factor = F.pow(F.lit(10.0), F.least(digits, F.lit(300)))
    return F.when(digits > 300, value).otherwise(F.rint(value * factor) / factor)


def round_significant(value: Column, ndigits: int) -> Column:
    return _round_at(value, _extra_digits(value) + ndigits)


def round_range(low: Column, high: Column, ndigits: int) -> tuple[Column, Column]:
    """Round both ends to the digits that suit the larger magnitude's need."""
    digits = F.least(_extra_digits(low), _extra_digits(high)) + ndigits
    return _round_at(low, digits), _round_at(high, digits)
