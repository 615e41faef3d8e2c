"""Window operators: persistence, cooldown, ranks, buckets, sequence scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.calendar import over_months


def persistent(flag: str, by: list[str], months: int = 2, month: str = "m") -> Column:
    """The flag holds in this month and the months - 1 calendar months before it."""
    w = over_months(by, -(months - 1), 0, month)
    return F.sum(F.col(flag).cast("int")).over(w) == months


def persistent_same_sign(flag: str, signed: str, by: list[str], months: int = 3, month: str = "m") -> Column:
    """As persistent(), and the signed value keeps its sign."""
    w = over_months(by, -(months - 1), 0, month)
    sign = F.signum(signed)
    return persistent(flag, by, months, month) & (F.min(sign).over(w) == F.max(sign).over(w)) & (F.min(sign).over(w) != 0)


def cooldown(df: DataFrame, by: list[str], months: int, month: str = "m") -> DataFrame:
    """Greedy: a row is kept when at least so many months have gone by since the last kept one.

    Whether a row is kept depends on the rows kept before it, so each key's distinct months are
    folded in order; the array holds months, which are few.
    """
    arrays = df.groupBy(*by).agg(F.array_sort(F.collect_set(month)).alias("_all"))
    start = F.array().cast("array<int>")
    kept = F.aggregate("_all", start, lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) >= months), F.concat(acc, F.array(x))).otherwise(acc))
    out = arrays.select(*by, F.explode(kept).alias(month))
    return df.join(out, [*by, month], "left_semi")


def percent_rank_mid(value: str, by: list[str]) -> Column:
    """100 P(x < v) + 50 P(x = v)."""
    w = Window.partitionBy(*by)
    below = F.rank().over(w.orderBy(value)) - 1
    equal = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return (F.lit(100) * below + F.lit(50) * equal) / F.count(F.lit(1)).over(w)


def greater_rank(value: str, by: list[str]) -> Column:
    """1 + how many are greater."""
    return F.rank().over(Window.partitionBy(*by).orderBy(F.desc(value)))


def quantile_bucket(df: DataFrame, by: list[str], value: str, parts: int) -> DataFrame:
    """df with bucket 0..parts-1 by exact quantile edges of its group, each closed on the right."""
    at = [i / parts for i in range(1, parts)]
    edges = df.groupBy(*by).agg(F.percentile(value, F.array(*(F.lit(p) for p in at))).alias("_edges"))
    j = df.join(edges, by)
    return j.withColumn("bucket", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")


def glr(value: str, by: list[str], month: str = "m", longest: int = 3) -> Column:
    """The largest of (sum of the last L)^2 / L over L = 1..longest, of windows with all their months."""
    parts = []
    for n in range(1, longest + 1):
        w = over_months(by, -(n - 1), 0, month)
        s = F.sum(value).over(w)
        parts.append(F.when(F.count(value).over(w) == n, s * s / n))
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def switches(df: DataFrame, by: list[str], order: str, label: str) -> DataFrame:
    """by, switches: how often the label changes along the order, blanks left out."""
    known = df.filter(F.col(label).isNotNull() & (F.col(label) != ""))
    prev = F.lag(label).over(Window.partitionBy(*by).orderBy(order))
    return known.withColumn("_p", prev).groupBy(*by).agg(F.count_if(F.col("_p") != F.col(label)).alias("switches"))


def successors(df: DataFrame, code: str, low: str, high: str, key: str) -> DataFrame:
    """Each interval with the next of its code: next_low, contiguous, overlaps."""
    nxt = F.lead(low).over(Window.partitionBy(code).orderBy(low, high, key))
    return df.withColumn("next_low", nxt).withColumns({"contiguous": F.col(high) == F.col("next_low"), "overlaps": F.col(high) > F.col("next_low")})


def top(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in an order with full ties."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
