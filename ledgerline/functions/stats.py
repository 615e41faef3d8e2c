"""Exact statistics: quantiles and medians are exact, spreads are of the population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The normal quartile: a MAD over it estimates a standard deviation.
QUARTILE = 0.67448975


def robust_z(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """df with z = QUARTILE (x - median) / MAD of its group, 0 where the MAD is 0. Two passes: medians, then deviations."""
    med = df.groupBy(*by).agg(F.median(value).alias("_med"))
    near = df.join(med, by)
    mad = near.groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("_med"))).alias("_mad"))
    z = F.when(F.col("_mad") == 0, 0.0).otherwise(F.lit(QUARTILE) * (F.col(value) - F.col("_med")) / F.nullif("_mad", F.lit(0.0)))
    return near.join(mad, by).withColumn("z", z).drop("_med", "_mad")


def mad(df: DataFrame, value: str, by: list[str], scale: float = 1.4826) -> DataFrame:
    """by, med, mad: the median and scaled median absolute deviation of each group."""
    med = df.groupBy(*by).agg(F.median(value).alias("med"))
    out = df.join(med, by).groupBy(*by, "med").agg(F.median(F.abs(F.col(value) - F.col("med"))).alias("_mad"))
    return out.select(*by, "med", (F.col("_mad") * scale).alias("mad"))


def gini(value: str, rank: str) -> Column:
    """Of x >= 0 with ranks from 1 in ascending order."""
    n, s = F.count(value), F.sum(value)
    return F.lit(2) * F.sum(F.col(rank) * F.col(value)) / (n * F.nullif(s, F.lit(0.0))) - (n + 1) / n


def hhi(value: str) -> Column:
    """Sum of squared shares."""
    return F.sum(F.col(value) * F.col(value)) / F.nullif(F.sum(value) * F.sum(value), F.lit(0.0))


def variation(value: str) -> Column:
    return F.stddev_pop(value) / F.nullif(F.abs(F.avg(value)), F.lit(0.0))


def slope(t: str, y: str) -> Column:
    """Least-squares slope of y on t."""
    return F.covar_pop(t, y) / F.nullif(F.var_pop(t), F.lit(0.0))


def errors(actual: str, predicted: str) -> dict[str, Column]:
    e = F.col(actual) - F.col(predicted)
    return {"mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "mse": F.avg(e * e)}
