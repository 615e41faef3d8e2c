"""Aggregates beyond the built-in ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sum_min_count(value: str, least: int) -> Column:
    """The sum, null unless at least so many values are known."""
    return F.when(F.count(value) >= least, F.sum(value))


def resolve_unique(value: str) -> Column:
    """The value when there is exactly one distinct known value, else null."""
    return F.when(F.min(value) == F.max(value), F.min(value))


def mode(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, mode, share, tied: the most frequent value, the least of those that tie."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*by).agg(F.max("n").alias("best"), F.sum("n").alias("all"))
    at = counts.join(best, by).filter(F.col("n") == F.col("best"))
    return at.groupBy(*by).agg(F.min(value).alias("mode"), (F.max("n") / F.max("all")).alias("share"), (F.count(F.lit(1)) > 1).alias("tied"))


def ranked(df: DataFrame, by: list[str], value: str, *ties: str) -> DataFrame:
    """df with rank from 1 in ascending order of value within by."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(value, *ties)))


def average_rank(value: str, by: list[str]) -> Column:
    """Ranks from 1, equal values share their mean."""
    w = Window.partitionBy(*by)
    first = F.rank().over(w.orderBy(value))
    return first + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def leave_group_out_mean(df: DataFrame, group: str, by: list[str], value: str) -> DataFrame:
    """by, group, rest: the mean over all other groups, from sums."""
    per = df.groupBy(*by, group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    rest_n = F.sum("n").over(w) - F.col("n")
    return per.select(*by, group, ((F.sum("s").over(w) - F.col("s")) / F.nullif(rest_n, F.lit(0))).alias("rest"))


def leave_one_out_median(df: DataFrame, by: list[str], value: str, key: str) -> DataFrame:
    """df with loo: the median of the group's other rows, exact for either parity and with ties.

    Dropping the row of rank r from n sorted values shifts the middle by at most one place, so
    each row needs at most two of the four values in the middle.
    """
    ordered = Window.partitionBy(*by).orderBy(value, key)
    rows = df.withColumns({"_r": F.row_number().over(ordered), "_n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    middle = rows.filter(F.abs(F.lit(2) * F.col("_r") - F.col("_n") - 1) <= 3).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_r", value))).alias("_mid"))  # four values at most
    joined = rows.join(middle, by)
    m = F.col("_n") - 1  # rows left
    low, high = F.floor((m + 1) / 2).cast("int"), (F.floor(m / 2) + 1).cast("int")
    at = lambda k: F.element_at("_mid", F.when(F.col("_r") <= k, k + 1).otherwise(k))
    loo = F.when(m > 0, (at(low) + at(high)) / 2)
    return joined.withColumn("loo", loo).drop("_r", "_n", "_mid")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row, ari: pair counts of two labellings; 1 when both are trivial alike, else 0 where undefined."""
    cells = contingency(df, a, b)
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("ra"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("ka"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("rb"), F.count(F.lit(1)).alias("kb"))
    both = cells.agg(F.sum(_pairs(F.col("n"))).alias("ab"), F.count(F.lit(1)).alias("kc"))
    one = rows.crossJoin(cols).crossJoin(both)  # one row each
    expected = F.col("ra") * F.col("rb") / F.nullif(_pairs(F.col("total")), F.lit(0.0))
    top, below = F.col("ab") - expected, (F.col("ra") + F.col("rb")) / 2 - expected
    same = (F.col("kc") == F.col("ka")) & (F.col("kc") == F.col("kb"))
    return one.select(F.when(below.isNull() | (below == 0), F.when(same, 1.0).otherwise(0.0)).otherwise(top / F.nullif(below, F.lit(0.0))).alias("ari"))


def normalised_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row, nmi: mutual information over the mean of the entropies; 1 when both are one cluster."""
    cells = contingency(df, a, b)
    w = Window.partitionBy(F.lit(0))
    cells = cells.withColumns({"na": F.sum("n").over(Window.partitionBy(a)), "nb": F.sum("n").over(Window.partitionBy(b)), "total": F.sum("n").over(w)})
    p = F.col("n") / F.col("total")
    mi = cells.agg(F.sum(p * F.ln(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"))

    def entropy(label: str, name: str) -> DataFrame:
        per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(w))
        return per.agg((-F.sum(F.col("p") * F.ln("p"))).alias(name))

    one = mi.crossJoin(entropy(a, "ha")).crossJoin(entropy(b, "hb"))  # one row each
    mean = (F.col("ha") + F.col("hb")) / 2
    return one.select(F.when(mean == 0, 1.0).otherwise(F.greatest(F.col("mi") / F.nullif(mean, F.lit(0.0)), F.lit(0.0))).alias("nmi"))


def jaccard(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: both, either, jaccard of two sets of keys."""
    x = a.select(keys).distinct().withColumn("_a", F.lit(1))
    y = b.select(keys).distinct().withColumn("_b", F.lit(1))
    both = x.join(y, keys, "full")
    sums = both.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count(F.lit(1)).alias("either"))
    return sums.withColumn("jaccard", F.col("both") / F.nullif("either", F.lit(0)))


def losses(df: DataFrame, actual: str, models: list[str]) -> DataFrame:
    """model, n, mae, rmse over the rows where every model and the actual are known."""
    known = df.na.drop(subset=[actual, *models])
    long = known.unpivot([actual], models, "model", "predicted")
    e = F.col(actual) - F.col("predicted")
    return long.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
