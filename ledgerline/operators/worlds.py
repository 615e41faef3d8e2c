"""Synthetic worlds, null models and shrinkage: seeded, made in parallel from row numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def worlds(spark: SparkSession, n: int, months: int, dims: int, seed: int = 3, rho: float = 0.4, heavy: bool = False) -> DataFrame:
    """world, m, x: dims-dimensional first-order autoregressive noise; each world is made from its own number."""

    def make(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for w in frame["id"]:
                rng = np.random.Generator(np.random.PCG64([seed, int(w)]))
                e = rng.standard_t(5, (months, dims)) * np.sqrt(3 / 5) if heavy else rng.standard_normal((months, dims))
                x = np.zeros(dims)
                for m in range(months):
                    x = rho * x + np.sqrt(1 - rho**2) * e[m]
                    out.append((int(w), m, x.tolist()))
            yield pd.DataFrame(out, columns=["world", "m", "x"])

    return spark.range(n).mapInPandas(make, "world long, m int, x array<double>")


def channels(df: DataFrame) -> DataFrame:
    """df with the scores stouffer, energy and max_abs of x."""
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    energy = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    return df.withColumns({"stouffer": F.abs(total) / F.sqrt(F.size("x")), "energy": energy, "max_abs": F.array_max(F.transform("x", F.abs))})


def joint_bank(null: DataFrame, budget: float) -> DataFrame:
    """One row: each channel's null quantile, and the quantile of the largest ratio to them, so that together they spend one budget."""
    names = ["stouffer", "energy", "max_abs"]
    scored = channels(null)
    q = scored.agg(*(F.percentile(c, F.lit(1 - budget)).alias(f"q_{c}") for c in names))
    ratio = F.greatest(*(F.col(c) / F.col(f"q_{c}") for c in names))
    joint = scored.join(F.broadcast(q), how="cross").agg(F.percentile(ratio, F.lit(1 - budget)).alias("joint"))  # one row
    return q.join(joint, how="cross")


def shrunk_precision(df: DataFrame, columns: list[str]) -> DataFrame:
    """i, j, correlation, precision under Ledoit-Wolf shrinkage to a scaled identity; moments come from one aggregation."""
    k = len(columns)
    x = [F.col(f"`{c}`") for c in columns]
    sums = [F.avg(c) for c in x]
    schema = "i string, j string, correlation double, precision double, shrinkage double"
    means = df.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
    if any(v is None for v in means):
        return df.sparkSession.createDataFrame([], schema)
    mean = np.array(means, float)
    z = [c - F.lit(float(m)) for c, m in zip(x, mean, strict=True)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(F.count(F.lit(1)), *(F.avg(z[i] * z[j]) for i, j in pairs), *(F.avg(z[i] * z[i] * z[j] * z[j]) for i, j in pairs)).first()
    n, s, q = row[0], np.zeros((k, k)), np.zeros((k, k))
    for (i, j), a, b in zip(pairs, row[1 : 1 + len(pairs)], row[1 + len(pairs) :], strict=True):
        s[i, j] = s[j, i] = a
        q[i, j] = q[j, i] = b
    mu = np.trace(s) / k
    distance = ((s - mu * np.eye(k)) ** 2).sum() / k
    spread = min(float((q - s * s).sum()) / n / k, distance)
    shrink = spread / distance if distance > 0 else 1.0
    cov = (1 - shrink) * s + shrink * mu * np.eye(k)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    corr = cov / np.outer(scale, scale)
    precision = np.linalg.pinv(corr)
    rows = [(columns[i], columns[j], float(corr[i, j]), float(precision[i, j]), float(shrink)) for i in range(k) for j in range(k)]
    return df.sparkSession.createDataFrame(rows, schema)
