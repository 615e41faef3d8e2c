"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in (doc_id, crc, size) order. A keyed Feistel network permutes the
next power of four at or above N; values that fall outside 0..N-1 are walked on until they
fall inside, which makes it a permutation of 0..N-1. The permuted number p gives
shard = p mod shards and slot = p div shards: shards differ by one row at most, slots have
no gaps, and any row's place follows from its number, N and the seed alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import number_rows, table

SHARDS = 24
SEED = 20260105
ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A keyed permutation of 0..n-1, with its inverse."""

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        with np.errstate(over="ignore"):
            self.keys = _mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def _round(self, x: np.ndarray, forward: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in self.keys if forward else self.keys[::-1]:
            if forward:
                left, right = right, left ^ (_mix(right ^ k) & self.mask)
            else:
                left, right = right ^ (_mix(left ^ k) & self.mask), left
        return (left << self.half) | right

    def _walk(self, x: np.ndarray, forward: bool) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = self._round(np.asarray(x).astype(np.uint64), forward)
            while (outside := np.flatnonzero(out >= np.uint64(self.n))).size:
                out[outside] = self._round(out[outside], forward)
        return out.astype(np.int64)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, True)

    def invert(self, y: np.ndarray) -> np.ndarray:
        return self._walk(y, False)


def place(row_number: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of row numbers among n rows."""
    p = Permutation(n, seed).apply(row_number)
    return p % shards, p // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """The row number that lies at (shard, slot): the inverse of place()."""
    return Permutation(n, seed).invert(np.asarray(slot) * shards + np.asarray(shard))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot; one row per row of docs.

    A null text has size 8 and the crc of an empty one; null doc_ids are numbered first;
    repeated rows each get a place; an empty table gives an empty result; other columns of
    docs are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 8).alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    numbered, n = number_rows(narrow, ["doc_id", "text_crc32", "size"], "row_number")

    @F.pandas_udf("long")
    def permuted(rn: pd.Series) -> pd.Series:
        return pd.Series(Permutation(n, seed).apply(rn.to_numpy()))

    return numbered.withColumn("_p", permuted("row_number")).select("doc_id", "size", "text_crc32", "row_number", (F.col("_p") % shards).cast("int").alias("shard"), F.expr(f"_p div {shards}").alias("slot"))


def op1_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
