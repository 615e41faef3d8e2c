"""Shared plumbing: durable intermediate tables, exact row numbers, skew-proof joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources.durable import new_folder

#: A group is hot when it holds more than 1/HOT_SHARE of the rows; so at most HOT_SHARE groups are.
HOT_SHARE = 1024
#: Up to so many ids (some MB) are broadcast after they were counted; more are joined by a shuffle.
BROADCAST_IDS = 1 << 18
BATCH = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH bytes for texts, where the session doesn't say: rows of documents are long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH)


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    path = f"{new_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, keys: list[str], rn: str = "rn") -> tuple[DataFrame, int]:
    """(df with exact global row numbers from 0 in the order of keys, number of rows).

    Range partitions are sorted on their own; the only thing summed over the whole table is
    one count per partition. df should be narrow: it is written to the shared folder first, as
    the ranges are sampled in a pass of its own, which would else read the texts again.
    """
    order = [F.col(k).asc_nulls_first() for k in keys]
    narrow = materialise(df, "narrow")
    placed = materialise(narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_mid", 33)
    counts = sorted(tuple(r) for r in placed.groupBy(part.alias("p")).count().collect())  # one row per partition
    offsets, total = [], 0
    for p, c in counts:
        offsets.append((p, total))
        total += c
    offset = placed.sparkSession.createDataFrame(offsets or [(0, 0)], "_p long, _off long")
    out = placed.withColumn("_p", part.cast("long")).join(F.broadcast(offset), "_p")
    return out.withColumn(rn, F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_off", "_mid"), total


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, n_rows: int, how: str = "left") -> DataFrame:
    """rows joined with groups (unique on keys, no null key); size is the number of rows in a group.

    Groups with more than n_rows/HOT_SHARE rows are at most HOT_SHARE many, so that part of
    groups is broadcast; the others go through a shuffle in which no key is large.
    """
    limit = max(n_rows // HOT_SHARE, 1)
    hot, cold = groups.filter(F.col(size) > limit), groups.filter(F.col(size) <= limit)
    if how == "left_anti":
        return rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold.select(keys), keys, "left_anti")
    on_hot = rows.join(F.broadcast(hot), keys, "inner" if how == "left" else how)
    on_cold = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(cold, keys, how)
    return on_hot.unionByName(on_cold)


def small(ids: DataFrame) -> DataFrame:
    """ids, a written table of a few numbers a row, marked for broadcast if it is small enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
