"""Nearest neighbours of vectors in blocks.

All pairs of vectors are compared, as exact neighbours need, but never as rows: vectors are
packed into blocks, each pair of blocks is one small matrix job, and only the k best of each
row and block leave it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048
DIGITS = 9
#: What a distance by matrix product may be off by before it is computed exactly, relative to the vectors' squares.
SLACK = 1e-9


def blocks_of(df: DataFrame, key: str, columns: dict[str, str], block: int) -> tuple[DataFrame, int]:
    """(b, rows: about `block` of the columns, named anew, each; number of blocks)."""
    blocks = max(1, -(-df.count() // block))
    rows = df.select(*(F.col(c).alias(n) for n, c in columns.items()), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b"))
    return rows.groupBy("b").agg(F.collect_list(F.struct(*columns)).alias("rows")), blocks


def block_pairs(packed: DataFrame, blocks: int) -> DataFrame:
    """mine, theirs: every block with every block."""
    left = packed.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("j", F.col("rows").alias("mine"))
    pairs = left.join(packed.select(F.col("b").alias("j"), F.col("rows").alias("theirs")), "j")
    return pairs.select("mine", "theirs").repartition(blocks * blocks) if blocks > 1 else pairs.select("mine", "theirs")


def _nearest(a: np.ndarray, ia: np.ndarray, b: np.ndarray, ib: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the k nearest: a matrix product leaves few candidates, whose distances are then exact."""
    sa, sb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    near = sa[:, None] + sb[None, :] - 2 * (a @ b.T)
    near[ia[:, None] == ib[None, :]] = np.inf
    reach = np.partition(near, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
    slack = SLACK * (1 + sa + sb.max()) + 10.0**-DIGITS
    q, r = np.nonzero(near <= (reach + slack)[:, None])
    q, r = q[np.isfinite(near[q, r])], r[np.isfinite(near[q, r])]
    d = np.round(((b[r] - a[q]) ** 2).sum(axis=1), DIGITS)
    order = np.lexsort((ib[r], d, q))
    q, r, d = q[order], r[order], d[order]
    best = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[best], r[best], d[best]


def nearest_vectors(df: DataFrame, key: str, vector: str, k: int, block: int = BLOCK) -> DataFrame:
    """node, other, d, rank: the k nearest others by (squared distance to DIGITS decimals, key)."""
    packed, blocks = blocks_of(df, key, {"id": key, "x": vector}, block)

    def best(frames):
        for frame in frames:
            for mine, theirs in zip(frame["mine"], frame["theirs"], strict=True):
                a, b = (np.array([r["x"] for r in z], float) for z in (mine, theirs))
                ia, ib = (np.array([r["id"] for r in z]) for z in (mine, theirs))
                for at in range(0, len(a), 256):
                    q, r, d = _nearest(a[at : at + 256], ia[at : at + 256], b, ib, k)
                    yield pd.DataFrame({"node": ia[at + q], "other": ib[r], "d": d})

    found = block_pairs(packed, blocks).mapInPandas(best, "node long, other long, d double")
    w = Window.partitionBy("node").orderBy("d", "other")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
