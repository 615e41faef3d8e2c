"""Calendar-exact windows over an integer month, and dates."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def at_lag(value: str, k: int, by: list[str], month: str = "m") -> Column:
    """The value exactly k months before, null when that month has no row: gaps are never closed."""
    return F.max(value).over(Window.partitionBy(*by).orderBy(month).rangeBetween(-k, -k))


def over_months(by: list[str], low: int, high: int, month: str = "m"):
    """The rows whose month lies between low and high months from this one."""
    return Window.partitionBy(*by).orderBy(month).rangeBetween(low, high)


def up_to(by: list[str], lag: int = 0, month: str = "m"):
    """All rows at or before the month less lag."""
    return Window.partitionBy(*by).orderBy(month).rangeBetween(Window.unboundedPreceding, -lag)


def season(month: str = "m") -> tuple[Column, Column]:
    """Sine and cosine of the month of the year."""
    angle = F.lit(2 * 3.141592653589793) * (F.col(month) % 12 + 1) / 12
    return F.sin(angle), F.cos(angle)


def parse_utc(text: Column) -> Column:
    """A timestamp in UTC of an ISO text with or without zone or time; null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def local_month(ts: Column, zone: str = "Europe/Moscow") -> Column:
    """The YYYY-MM in a zone of a UTC timestamp."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM")


def available_at(published: Column, seen: Column) -> Column:
    """The later of both, null when either is unknown."""
    return F.when(published.isNotNull() & seen.isNotNull(), F.greatest(published, seen))
