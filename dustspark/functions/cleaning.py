"""Value cleaning: numeric sanitising, clamps, units, time keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(value: Column | str, default: float | None = None) -> Column:
    """Any input as a finite double: null, blank, unparsable, NaN and infinities become the default."""
    x = (F.col(value) if isinstance(value, str) else value).cast("string").try_cast("double")
    finite = F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
    return finite if default is None else F.coalesce(finite, F.lit(float(default)))


def finite(value: Column, default: float | None = None) -> Column:
    """Same as ``num`` for a column that is a double already."""
    x = F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
    return x if default is None else F.coalesce(x, F.lit(float(default)))


def at_least(value: Column, low: float) -> Column:
    """The value, but not below ``low``; null stays null (``greatest`` alone would skip it)."""
    return F.when(value < low, F.lit(float(low))).otherwise(value)


def clamp(value: Column, low: float, high: float) -> Column:
    """The value within [low, high]; null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))))


def nonzero(value: Column, default: Column | float) -> Column:
    """The value, or the default when it is null *or zero*."""
    other = default if isinstance(default, Column) else F.lit(float(default))
    return F.coalesce(F.nullif(value, F.lit(0.0)), other)


def mj_to_kwh(value: Column) -> Column:
    return value / 3.6


def wh_to_kwh(value: Column) -> Column:
    return value / 1000.0


def kmh_to_ms(value: Column) -> Column:
    return value / 3.6


def ms_to_kmh(value: Column) -> Column:
    return value * 3.6


def kwp_to_mwp(value: Column) -> Column:
    return value / 1000.0


def day_key(ts: Column, tz: str | None = None) -> Column:
    """Local calendar day of a UTC timestamp; without a zone the stamp is local already."""
    return F.to_date(F.from_utc_timestamp(ts, tz)) if tz else F.to_date(ts)


def doy_angle(date: Column, offset: int = 0) -> Column:
    """Angle of the day of year. Training and serving share the offset given by the caller."""
    return 2 * F.pi() * (F.dayofyear(date) - F.lit(offset)) / 365.25
