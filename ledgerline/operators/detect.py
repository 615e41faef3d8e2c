"""Detectors: thresholds, stateful change detection, matching and scoring of alarms.

Stateful detectors are folds along one series and run per series in Arrow batches; a series
is a few hundred months at most, so no task holds more than one series at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import stats


def page_hinkley(df: DataFrame, by: list[str], month: str, value: str, delta: float = 0.05, threshold: float = 0.5) -> DataFrame:
    """by, month, statistic, alarm: two-sided Page-Hinkley on the log value; mean and sums start anew after an alarm."""
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*by, month])

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(month)
        out, n, mean, up, down = [], 0, 0.0, 0.0, 0.0
        for x in np.log(rows[value].to_numpy()):
            n += 1
            mean += (x - mean) / n
            up, down = max(0.0, up + x - mean - delta), max(0.0, down - x + mean - delta)
            score = max(up, down)
            out.append((score, score > threshold))
            if score > threshold:
                n, mean, up, down = 0, 0.0, 0.0, 0.0
        return pd.DataFrame({**{c: rows[c].to_numpy() for c in [*by, month]}, "statistic": [s for s, _ in out], "alarm": [a for _, a in out]})

    return df.select(*by, month, value).groupBy(*by).applyInPandas(fold, f"{kinds}, statistic double, alarm boolean")


def online_changepoint(df: DataFrame, by: list[str], month: str, value: str, hazard: float = 1 / 50, longest: int = 24, threshold: float = 0.5) -> DataFrame:
    """by, month, p_recent, alarm: Bayesian run lengths with a Gaussian of unknown mean and variance, restarted after an alarm.

    p_recent is the probability that the run began within the last two months, once there are four.
    The scale of the prior is the median absolute step of the log value up to the month itself.
    """
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*by, month])

    def density(x: float, m, k, a, b):
        s2 = b * (k + 1) / (a * k)
        z = (x - m) ** 2 / (2 * a * s2)
        from math import lgamma

        c = np.array([lgamma(q + 0.5) - lgamma(q) for q in a])
        return np.exp(c - (a + 0.5) * np.log1p(z) - 0.5 * np.log(2 * np.pi * a * s2))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(month)
        x = np.log(rows[value].to_numpy())
        steps, out, state = np.abs(np.diff(x)), [], None
        for i, q in enumerate(x):
            scale = max(float(np.median(steps[:i])), 1e-6) if i else 1.0
            if state is None:
                state, seen = (np.ones(1), np.array([q]), np.ones(1), np.ones(1), np.array([scale**2])), 0
            p, m, k, a, b = state
            like = p * density(q, m, k, a, b)
            grown = np.concatenate([[like.sum() * hazard], like * (1 - hazard)])
            grown /= max(grown.sum(), 1e-300)
            m2 = np.concatenate([[q], (k * m + q) / (k + 1)])
            b2 = np.concatenate([[scale**2], b + k * (q - m) ** 2 / (2 * (k + 1))])
            state = tuple(s[:longest] for s in (grown, m2, np.concatenate([[1.0], k + 1]), np.concatenate([[1.0], a + 0.5]), b2))
            state = (state[0] / state[0].sum(), *state[1:])
            seen += 1
            recent = float(state[0][:2].sum()) if seen >= 4 else 0.0
            out.append((recent, recent > threshold))
            if recent > threshold:
                state = None
        return pd.DataFrame({**{c: rows[c].to_numpy() for c in [*by, month]}, "p_recent": [s for s, _ in out], "alarm": [a for _, a in out]})

    return df.select(*by, month, value).groupBy(*by).applyInPandas(fold, f"{kinds}, p_recent double, alarm boolean")


def dormancy(seen: DataFrame, by: list[str], month: str, first: int, last: int, patience: int = 3) -> DataFrame:
    """by, month, status: active, dormant for up to patience missed months, retired on the next, until seen again.

    The gap since the last sighting decides, so a calendar grid and one window do it.
    """
    keys = seen.groupBy(*by).agg(F.min(month).alias("_first"))
    every = keys.withColumn(month, F.explode(F.sequence(F.greatest(F.col("_first"), F.lit(first)), F.lit(last)))).drop("_first")
    marked = every.join(seen.select(*by, month).distinct().withColumn("_seen", F.col(month)), [*by, month], "left")
    gap = F.col(month) - F.max("_seen").over(Window.partitionBy(*by).orderBy(month))
    return marked.select(*by, month, F.when(gap == 0, "active").when(gap <= patience, "dormant").otherwise("retired").alias("status"))


def online_top(df: DataFrame, month: str, key: list[str], score: str, k: int, cooldown: int) -> DataFrame:
    """Per month the k best keys among those not chosen within the last cooldown months.

    A month's choice depends on the months before it alone. Only the k (cooldown + 1) best of
    a month can matter, as at most k cooldown keys are barred; this bounded list is folded.
    """
    w = Window.partitionBy(month).orderBy(F.desc(score), *key)
    best = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k * (cooldown + 1))
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [month, *key, score])

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([month, "_r"])
        last: dict[tuple, int] = {}
        out = []
        for m, group in rows.groupby(month, sort=True):
            chosen = 0
            for r in group.itertuples(index=False):
                name = tuple(getattr(r, c) for c in key)
                if chosen < k and m - last.get(name, -(10**9)) > cooldown:
                    out.append((m, *name, getattr(r, score)))
                    last[name] = m
                    chosen += 1
        return pd.DataFrame(out, columns=[month, *key, score])

    # months x k (cooldown + 1) rows in all: the calendar bounds them
    return best.select(month, *key, score, "_r").withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda rows: fold(rows.drop(columns="_all")), kinds)


def threshold_alarms(df: DataFrame, train: DataFrame, by: list[str], month: str, rel: str, k: float) -> DataFrame:
    """by, month, score, alarm: |rel| over the MAD of the training rows (0.05 where it is none) beyond k, in this month and the one before."""
    spread = stats.mad(train, rel, by).select(*by, "mad")
    scored = df.join(spread, by, "left").withColumn("score", F.abs(rel) / F.when(F.col("mad") > 0, F.col("mad")).otherwise(0.05))
    hot = scored.withColumn("hot", F.col("score") > k)
    w = Window.partitionBy(*by).orderBy(month).rangeBetween(-1, 0)
    return hot.select(*by, month, "score", (F.sum(F.col("hot").cast("int")).over(w) == 2).alias("alarm"))


def inject(df: DataFrame, events: DataFrame, by: list[str], month: str, value: str) -> DataFrame:
    """df with the value of each event's months multiplied by 1 + size; only rows that exist change."""
    months = events.withColumn(month, F.explode(F.sequence(F.col("onset"), F.col("onset") + F.col("length") - 1)))
    factor = months.groupBy(*by, month).agg(F.exp(F.sum(F.log1p("size"))).alias("_f"))
    return df.join(factor, [*by, month], "left").withColumn(value, F.col(value) * F.coalesce("_f", F.lit(1.0))).drop("_f")


def forward_hits(alarms: DataFrame, onsets: DataFrame, by: list[str], window: int) -> DataFrame:
    """onsets with hit and delay: the first alarm from the onset to window months on."""
    ahead = onsets.withColumn("m", F.explode(F.sequence(F.col("onset"), F.col("onset") + window)))
    found = ahead.join(alarms.select(*by, "m").distinct(), [*by, "m"]).groupBy(*by, "onset").agg(F.min(F.col("m") - F.col("onset")).alias("delay"))
    return onsets.join(found, [*by, "onset"], "left").withColumn("hit", F.col("delay").isNotNull())


def greedy_match(alarms: DataFrame, onsets: DataFrame, by: list[str], window: int) -> DataFrame:
    """onsets with at most one alarm each and each alarm once: onsets in order take the nearest free alarm, (|d|, d, month)."""
    from ledgerline.operators.joins import near_month

    near = near_month(alarms.select(*by, "m").distinct(), onsets.select(*by, "onset"), by, window)
    kinds = ", ".join(f"{c} {onsets.schema[c].dataType.simpleString()}" for c in [*by, "onset"])

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        rows = rows.assign(a=rows["d"].abs()).sort_values(["onset", "a", "d", "m"])
        for onset, group in rows.groupby("onset", sort=True):
            for r in group.itertuples(index=False):
                if r.m not in used:
                    used.add(r.m)
                    out.append((*(rows[c].iloc[0] for c in by), onset, r.m, r.d))
                    break
        return pd.DataFrame(out, columns=[*by, "onset", "m", "d"])

    return near.groupBy(*by).applyInPandas(fold, f"{kinds}, m int, d int")


def score(matched: DataFrame, onsets: DataFrame, alarms: DataFrame) -> DataFrame:
    """One row: events, alarms, hits, recall, precision, false_alarms, mean_delay, mean_abs_delay, early_share."""
    hits = matched.agg(F.count(F.lit(1)).alias("hits"), F.avg("d").alias("mean_delay"), F.avg(F.abs("d")).alias("mean_abs_delay"), F.avg((F.col("d") < 0).cast("int")).alias("early_share"))
    one = onsets.agg(F.count(F.lit(1)).alias("events")).crossJoin(alarms.agg(F.count(F.lit(1)).alias("alarms"))).crossJoin(hits)  # one row each
    return one.withColumns({"recall": F.col("hits") / F.nullif("events", F.lit(0)), "precision": F.col("hits") / F.nullif("alarms", F.lit(0)), "false_alarms": F.col("alarms") - F.col("hits")})
