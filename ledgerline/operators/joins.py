"""Joins with contracts: cardinality, reconciliation, calendar, as-of, band, nearest and peer matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asserted(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner", validate: str = "one_to_one") -> DataFrame:
    """A join that fails when a side that must be unique on the keys isn't; the check rides in the join's own shuffle."""

    def unique(df: DataFrame, side: str) -> DataFrame:
        n = F.count(F.lit(1)).over(Window.partitionBy(*on))
        return df.withColumn("_n", n).filter(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{side} keys repeat")).cast("boolean")).otherwise(True)).drop("_n")

    left, right = validate.split("_to_")
    return (unique(a, "left") if left == "one" else a).join(unique(b, "right") if right == "one" else b, on, how)


def reconcile(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join with _merge: left_only, right_only or both."""
    x, y = a.withColumn("_in_a", F.lit(True)), b.withColumn("_in_b", F.lit(True))
    merge = F.when(F.col("_in_a").isNull(), "right_only").when(F.col("_in_b").isNull(), "left_only").otherwise("both")
    return x.join(y, on, "full").withColumn("_merge", merge).drop("_in_a", "_in_b")


def revision_diff(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """on, old, new, status: added, removed, changed or same."""
    r = reconcile(a.select(*on, F.col(value).alias("old")), b.select(*on, F.col(value).alias("new")), on)
    status = F.when(F.col("_merge") == "right_only", "added").when(F.col("_merge") == "left_only", "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed").otherwise("same")
    return r.withColumn("status", status).drop("_merge")


def equal_masks(a: DataFrame, b: DataFrame, on: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """One row: extra keys on either side and values that differ; accepted when there are none."""
    r = reconcile(a.select(*on, F.col(value).alias("_x")), b.select(*on, F.col(value).alias("_y")), on)
    out = r.agg(F.count_if(F.col("_merge") != "both").alias("extra"), F.count_if((F.col("_merge") == "both") & (F.abs(F.col("_x") - F.col("_y")) > tolerance)).alias("differ"))
    return out.withColumn("accepted", (F.col("extra") == 0) & (F.col("differ") == 0))


def overlapping(a: DataFrame, code: str, low: str, high: str, key: str) -> DataFrame:
    """Pairs of rows of one code whose half-open intervals overlap, key_a < key_b; the code is the equi key."""
    x = a.select(F.col(code).alias("code"), F.col(key).alias("key_a"), F.col(low).alias("la"), F.col(high).alias("ha"))
    y = a.select(F.col(code).alias("code"), F.col(key).alias("key_b"), F.col(low).alias("lb"), F.col(high).alias("hb"))
    return x.join(y, "code").filter((F.col("key_a") < F.col("key_b")) & (F.col("la") < F.col("hb")) & (F.col("lb") < F.col("ha")))


def near_month(alarms: DataFrame, onsets: DataFrame, by: list[str], window: int) -> DataFrame:
    """Candidate (alarm, onset) pairs at most window months apart, banded: the onset's months are exploded into an equi key."""
    near = onsets.withColumn("m", F.explode(F.sequence(F.col("onset") - window, F.col("onset") + window)))
    return alarms.join(near, [*by, "m"]).withColumn("d", F.col("m") - F.col("onset"))


def as_of(facts: DataFrame, known: DataFrame, by: list[str], at: str, available: str, columns: list[str]) -> DataFrame:
    """facts with, of the rows of known that were available at or before `at`, the latest; unknown availability never counts.

    Both sides are merged into one sorted stream per key, so no pair of them is formed.
    """
    f = facts.withColumns({"_t": F.col(at), "_fact": F.lit(1), **{c: F.lit(None).cast(known.schema[c].dataType) for c in columns}})
    own = [c for c in facts.columns if c not in by]
    k = known.filter(F.col(available).isNotNull()).select(*by, *(F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in own), F.col(available).alias("_t"), F.lit(0).alias("_fact"), *columns)
    both = f.select(k.columns).unionByName(k)
    w = Window.partitionBy(*by).orderBy("_t", "_fact").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.struct(*columns)
    held = both.withColumn("_held", F.last(F.when(F.col("_fact") == 0, seen), ignorenulls=True).over(w)).filter("_fact = 1")
    return held.select(*facts.columns, *(F.col(f"_held.{c}").alias(c) for c in columns))


def undirected(edges: DataFrame, x: str, y: str, distance: str) -> DataFrame:
    """u < v, distance: endpoints in order, the least distance of duplicates; loops and distances that aren't positive numbers go."""
    d = F.col(distance)
    good = edges.filter((F.col(x) != F.col(y)) & d.isNotNull() & ~F.isnan(d) & (d > 0) & (d < float("inf")))
    return good.groupBy(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")).agg(F.min(distance).alias("distance"))


def nearest(pairs: DataFrame, node: str, other: str, distance: str, k: int) -> DataFrame:
    """The k nearest of each node, by (distance, id)."""
    w = Window.partitionBy(node).orderBy(distance, other)
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def squared_distance(a: Column, b: Column) -> Column:
    """Of two arrays of numbers, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def mutual(neighbours: DataFrame, node: str, other: str, both: bool = True) -> DataFrame:
    """u < v: edges that both ends name (mutual), or either (union)."""
    e = neighbours.groupBy(F.least(node, other).alias("u"), F.greatest(node, other).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return (e.filter("n = 2") if both else e).drop("n")
