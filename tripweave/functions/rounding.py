"""Correctly rounded decimals of a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1: cuts a double in two halves whose products are exact


def _halves(x: float) -> tuple[float, float]:
    c = x * _SPLIT
    high = c - (c - x)
    return high, x - high


def round_exact(x: Column, digits: int) -> Column:
    """``x`` rounded to ``digits`` decimals by its exact binary value, ties to even.

    Spark's round() works on the printed digits and so lifts 2.675 to 2.68, though
    the double lies below. Only values within 1e-4 of a tie pay for the product's
    error term; for |x| * 10**digits below 1e12 the others cannot be tipped by it.
    """
    scale = float(10**digits)
    s_high, s_low = _halves(scale)
    p = x * F.lit(scale)
    nearest = F.rint(p)
    c = x * F.lit(_SPLIT)
    high = c - (c - x)
    low = x - high
    error = ((high * s_high - p) + high * s_low + low * s_high) + low * s_low
    floor = F.floor(p).cast("double")
    side = (p - floor - 0.5) + error
    tie = floor + F.when(side > 0, 1.0).when(side < 0, 0.0).otherwise(F.pmod(floor, F.lit(2.0)))
    return F.when(F.abs(p - nearest) < 0.4999, nearest).otherwise(tie) / F.lit(scale)
