"""Set operators and global positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.sources.durable import written


def positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df with its place from 1 in a global order, without one task for all rows.

    The rows are range-partitioned and sorted; a row's place is its place in its partition
    after the rows of the partitions before, of which only counts are gathered.
    """
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = sorted(tuple(r) for r in placed.groupBy(part.alias("p")).count().collect())
    before, rows = 0, []
    for p, n in counts:
        rows.append((p, before))
        before += n
    start = df.sparkSession.createDataFrame(rows or [(0, 0)], "_p long, _before long")
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_p", part.cast("long")).join(F.broadcast(start), "_p").withColumn(name, F.col("_before") + inside + 1).drop("_p", "_id", "_before")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a as often as they occur in a beyond b."""
    return a.exceptAll(b.select(a.columns))


def coverage(a: DataFrame, b: DataFrame, keys: list[str], missed: int = 5) -> DataFrame:
    """One row: how many keys of a are in b, of how many, their share and the first few that aren't."""
    x, y = a.select(keys).distinct(), b.select(keys).distinct().withColumn("_in", F.lit(1))
    j = x.join(y, keys, "left")
    out = j.agg(F.count("_in").alias("covered"), F.count(F.lit(1)).alias("of"))
    first = j.filter(F.col("_in").isNull()).select(F.struct(*keys).alias("k")).orderBy("k").limit(missed).agg(F.array_sort(F.collect_list("k")).alias("missed"))
    return out.crossJoin(first).withColumn("coverage", F.col("covered") / F.nullif("of", F.lit(0)))  # one row each


def in_all(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys present in every frame: one union and one count instead of a chain of joins."""
    tagged = [f.select(keys).distinct().withColumn("_i", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f)
    return out.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(frames)).select(keys)


def both_ways(edges: DataFrame, x: str, y: str) -> DataFrame:
    """Each edge in both directions, once."""
    turned = edges.withColumns({x: F.col(y), y: F.col(x)})
    return edges.unionByName(turned).distinct()
