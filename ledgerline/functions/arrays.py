"""Reductions of arrays of doubles; the first of equal extremes counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def mean(x: Column) -> Column:
    return total(x) / F.nullif(F.size(x), F.lit(0))


def argmax(x: Column) -> Column:
    return F.array_position(x, F.array_max(x)) - 1


def argmin(x: Column) -> Column:
    return F.array_position(x, F.array_min(x)) - 1
