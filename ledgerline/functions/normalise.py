"""Normalisers as window expressions: statistics are population statistics, and a zero width gives zero."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def over(by: list[str]):
    if not by:
        raise ValueError("a window without keys would bring the whole table into one task: aggregate and join the one row instead")
    return Window.partitionBy(*by)


def z_score(value: str, by: list[str]) -> Column:
    w, x = over(by), F.col(value)
    spread = F.stddev_pop(x).over(w)
    return F.when(spread == 0, 0.0).otherwise((x - F.avg(x).over(w)) / F.nullif(spread, F.lit(0.0)))


def min_max(value: str, by: list[str]) -> Column:
    w, x = over(by), F.col(value)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high == low, 0.0).otherwise((x - low) / F.nullif(high - low, F.lit(0.0)))


def mean_index(value: str, by: list[str]) -> Column:
    w, x = over(by), F.col(value)
    mean = F.avg(x).over(w)
    return F.when(mean == 0, 0.0).otherwise(F.lit(100) * x / F.nullif(mean, F.lit(0.0)))


def log1p_guarded(value: str) -> Column:
    """ln(1 + x), an error at or below -1."""
    x = F.col(value)
    return F.when(x <= -1, F.raise_error(F.lit("log1p needs values above -1")).cast("double")).otherwise(F.log1p(x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is null or not positive."""
    return F.when(b > 0, a / F.nullif(b, F.lit(0.0)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def kopecks(amount: Column, factor: int = 1) -> Column:
    """A decimal text in units of factor roubles as whole kopecks; null unless it is exact."""
    cents = amount.try_cast("decimal(30,10)") * 100 * factor
    return F.when(cents == F.floor(cents), cents.cast("long"))
