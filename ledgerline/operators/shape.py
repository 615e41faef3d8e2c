"""Reshaping: one-hot, reason ladders, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_hot(df: DataFrame, column: str, vocabulary: list[str], prefix: str) -> DataFrame:
    """0/1 columns for the sorted vocabulary of the training rows but its first, the reference, which also takes unseen values."""
    return df.withColumns({f"{prefix}_{v.lower()}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in sorted(vocabulary)[1:]})


def ladder(steps: list[tuple[str, Column]], otherwise: str) -> Column:
    """The first reason whose condition holds."""
    out = F.when(F.coalesce(steps[0][1], F.lit(False)), steps[0][0])
    for reason, condition in steps[1:]:
        out = out.when(F.coalesce(condition, F.lit(False)), reason)
    return out.otherwise(otherwise)


def pivot(df: DataFrame, by: list[str], column: str, values: list, measure: Column) -> DataFrame:
    """Long to wide over stated values, in one aggregation."""
    return df.groupBy(*by).pivot(column, values).agg(measure)
