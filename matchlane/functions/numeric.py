"""Clipping and fixed-point formatting."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def saturate(x: Column, cap: float) -> Column:
    """``min(x, cap) / cap``"""
    return F.least(x.cast("double"), F.lit(float(cap))) / F.lit(float(cap))


def decay(x: Column, start: float, rate: float) -> Column:
    """1 up to ``start``, then linear decay by ``rate`` per unit, floored at 0."""
    return clip(1.0 - rate * (x - start), 0.0, 1.0)


def rescale(x: Column, low: float, high: float) -> Column:
    """Position of ``x`` inside ``[low, high]``, clipped to [0, 1]."""
    return clip((x - low) / (high - low), 0.0, 1.0)


def fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x)


def safe_float(text: Column) -> Column:
    return text.try_cast("double")


def half_even(x: Column, digits: int) -> Column:
    """Rounded half to even on the decimal value; noise beyond nine decimals makes no tie go astray."""
    return F.bround(F.round(x, 9), digits)
