"""Clusters over time: their regions, thresholds of recognition, identities, and worlds to test them on.

A cluster of a month is a region: a centre and an isotropic variance. Spark makes the regions;
identities are then followed over months x clusters, a table that doesn't grow with the rows.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.draws import RANGE, draw
from ledgerline.operators.joins import squared_distance
from ledgerline.sources.durable import written

#: Months that an identity may be missed and still come back.
PATIENCE = 3
#: P(a Poisson count of mean 1 is at least 1, 2, ...).
TAILS = [float(t) for t in 1 - np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 8)]))]
WORLDS = ("stationary", "drift", "birth", "death", "split", "merge", "proximity")


def regions(rows: DataFrame, month: str, label: str, vector: str, by: list[str] | None = None) -> DataFrame:
    """by, month, label, n, centre, var: var is the mean squared distance to the centre over the dimensions."""
    keys = [*(by or []), month, label]
    long = rows.select(*keys, F.posexplode(F.transform(vector, lambda v: v.cast("double"))).alias("i", "v"))
    each = long.groupBy(*keys, "i").agg(F.avg("v").alias("c"), F.var_pop("v").alias("s"), F.count(F.lit(1)).alias("n"))
    packed = each.groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "c"))).alias("_c"), F.avg("s").alias("var"))  # one entry a dimension
    return packed.select(*keys, "n", F.transform("_c", lambda x: x["c"]).alias("centre"), "var")


def overlap(c1: np.ndarray, v1: np.ndarray, c2: np.ndarray, v2: np.ndarray) -> np.ndarray:
    """Bhattacharyya overlap of isotropic Gaussians, every one of the first with every one of the second."""
    v1, v2 = np.maximum(v1, 1e-12)[:, None], np.maximum(v2, 1e-12)[None, :]
    mean = (v1 + v2) / 2
    d2 = ((c1[:, None, :] - c2[None, :, :]) ** 2).sum(axis=2)
    return np.exp(-d2 / (8 * mean) - c1.shape[1] / 2 * np.log(mean / np.sqrt(v1 * v2)))


def resampled(rows: DataFrame, key: str, month: str, label: str, vector: str, draws: int = 40, seed: int = 31, least: int = 2) -> DataFrame:
    """draw, month, label, other, overlap: of each cluster's resampled region with every region of its month; clusters of fewer than least rows are left out.

    A row's weight in a draw is a Poisson count made from its key, so a draw is one aggregation.
    """
    left = 1 - draw(key, month, "draw", seed=seed) / F.lit(float(RANGE))
    times = sum((left <= t).cast("int") for t in TAILS)
    each = rows.select(key, month, label, vector).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_t", times).filter("_t > 0")
    long = each.select("draw", month, label, "_t", F.posexplode(F.transform(vector, lambda v: v.cast("double"))).alias("i", "v"))
    n, s, q = F.sum("_t"), F.sum(F.col("_t") * F.col("v")), F.sum(F.col("_t") * F.col("v") * F.col("v"))
    made = long.groupBy("draw", month, label, "i").agg((s / n).alias("c"), F.greatest(q / n - (s / n) * (s / n), F.lit(0.0)).alias("s"))
    made = made.groupBy("draw", month, label).agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("_c"), F.avg("s").alias("v1")).select("draw", month, label, F.transform("_c", lambda x: x["c"]).alias("c1"), "v1")
    own = written(regions(rows, month, label, vector).filter(F.col("n") >= least).select(month, F.col(label).alias("other"), F.col("centre").alias("c2"), F.col("var").alias("v2")))
    pairs = made.join(own.select(month, F.col("other").alias(label)), [month, label]).join(F.broadcast(own), month)  # months x clusters
    v1, v2 = F.greatest("v1", F.lit(1e-12)), F.greatest("v2", F.lit(1e-12))
    mean = (v1 + v2) / 2
    o = F.exp(-squared_distance(F.col("c1"), F.col("c2")) / (8 * mean) - F.size("c1") / 2 * F.ln(mean / F.sqrt(v1 * v2)))
    return pairs.select("draw", month, label, "other", o.alias("overlap"))


def calibrate(overlaps: DataFrame, label: str) -> DataFrame:
    """One row of resampled(): keep, margin and floor for follow().

    keep is the 95 % quantile of the overlaps with others, margin how far the 5 % quantile of
    the own ones lies above it (0 where it doesn't, which `ambiguous` says), floor the median
    with others. Without overlaps of both kinds they are 0.5, 0 and 0.25.
    """
    same = F.col(label) == F.col("other")
    own, other = F.when(same, F.col("overlap")), F.when(~same, F.col("overlap"))
    q = overlaps.agg(F.percentile(own, F.lit(0.05)).alias("own_q05"), F.percentile(other, F.lit(0.95)).alias("other_q95"), F.percentile(other, F.lit(0.5)).alias("other_q50"))
    known = F.col("own_q05").isNotNull() & F.col("other_q95").isNotNull()
    keep = F.when(known, F.col("other_q95")).otherwise(0.5)
    margin = F.when(known, F.greatest(F.col("own_q05") - F.col("other_q95"), F.lit(0.0))).otherwise(0.0)
    return q.select("own_q05", "other_q95", keep.alias("keep"), margin.alias("margin"), F.when(known, F.col("other_q50")).otherwise(0.25).alias("floor"), (known & (F.col("own_q05") < F.col("other_q95"))).alias("ambiguous"))


def margins(overlaps: DataFrame, by: list[str], label: str) -> DataFrame:
    """by, label, draw, own, other, gap: a cluster's overlap with itself and its greatest with another, draw by draw."""
    same = F.col(label) == F.col("other")
    each = overlaps.groupBy(*by, label, "draw").agg(F.max(F.when(same, F.col("overlap"))).alias("own"), F.max(F.when(~same, F.col("overlap"))).alias("best_other"))
    return each.select(*by, label, "draw", "own", F.col("best_other").alias("other"), (F.col("own") - F.col("best_other")).alias("gap"))


class Identity:
    def __init__(self, name: int):
        self.name, self.seen, self.centre, self.var = name, -1, None, 0.0


def _follow(table: pd.DataFrame, keep: float, margin: float, floor: float, patience: int) -> list[tuple]:
    """(month, label or None, identity or None, status, overlap, margin) of one table of regions."""
    events, alive, fresh = [], [], 0
    for at, (month, here) in enumerate(table.sort_values(["month", "label"]).groupby("month", sort=True)):
        labels = here["label"].tolist()
        centres, variances = np.array(here["centre"].tolist(), float), here["var"].to_numpy(float)
        best, lead, whose = np.zeros(len(labels)), np.zeros(len(labels)), [None] * len(labels)
        if alive:
            o = overlap(centres, variances, np.array([x.centre for x in alive]), np.array([x.var for x in alive]))
            ranked = -np.sort(-o, axis=1)
            best, lead = ranked[:, 0], ranked[:, 0] - (ranked[:, 1] if len(alive) > 1 else 0.0)
            # the strongest recognition takes an identity; who comes later to the same one is ambiguous
            taken = set()
            for c in sorted(range(len(labels)), key=lambda c: -best[c]):
                i = int(np.argmax(o[c]))
                if best[c] >= keep and lead[c] > margin and i not in taken:
                    whose[c] = alive[i]
                    taken.add(i)
        for c, label in enumerate(labels):
            identity = whose[c]
            if identity is not None:
                status = "continuing" if identity.seen == at - 1 else "reemergence"
            elif at and best[c] >= keep:
                status = "ambiguous"
            else:
                status = "initial" if at == 0 else "birth_candidate" if best[c] >= floor else "birth"
                identity, fresh = Identity(fresh), fresh + 1
                alive.append(identity)
            if identity is not None:
                identity.seen, identity.centre, identity.var = at, centres[c], float(variances[c])
            events.append((month, label, None if identity is None else identity.name, status, float(best[c]), float(lead[c])))
        for identity in alive:
            if identity.seen < at:
                events.append((month, None, identity.name, "dormant" if at - identity.seen <= patience else "disappearance", None, None))
        alive = [x for x in alive if at - x.seen <= patience]
    return events


def follow(found: DataFrame, month: str, label: str, thresholds: DataFrame, by: list[str] | None = None, patience: int = PATIENCE) -> DataFrame:
    """by, month, label, identity, status, overlap, margin for regions(): who each cluster is, and who is away.

    A cluster is recognised when its best overlap with an identity not yet retired is at least
    keep and leads the second by more than margin: continuing, or reemergence after missed
    months. Two claims to one identity go to the greater overlap. What is like enough to one but
    not clearly is ambiguous and has no identity; else a birth_candidate (from floor on) or a
    birth; the first month's are initial. An identity not seen is dormant for up to patience
    months, then there is its disappearance, and it never returns. thresholds: one row.
    """
    by = by or []
    kinds = "".join(f"{c} {found.schema[c].dataType.simpleString()}, " for c in by)
    rows = found.join(F.broadcast(thresholds.select("keep", "margin", "floor")), how="cross")  # one row
    m, l = found.schema[month].dataType.simpleString(), found.schema[label].dataType.simpleString()

    def run(table: pd.DataFrame) -> pd.DataFrame:
        events = _follow(table.rename(columns={month: "month", label: "label"}), *table[["keep", "margin", "floor"]].iloc[0], patience)
        out = pd.DataFrame(events, columns=[month, label, "identity", "status", "overlap", "lead"]).astype({"identity": "Int64", label: "Int64" if l in ("int", "bigint") else object})
        for i, c in enumerate(by):
            out.insert(i, c, table[c].iloc[0])
        return out

    keyed = rows if by else rows.withColumn("_all", F.lit(0))
    # months x clusters rows in a group
    return keyed.groupBy(*(by or ["_all"])).applyInPandas(run, f"{kinds}{month} {m}, {label} {l}, identity long, status string, overlap double, lead double")


def world(name: str, points: int = 200, months: int = 24, dims: int = 5, seed: int = 20) -> tuple[np.ndarray, list[np.ndarray], list[tuple[int, str, str]]]:
    """(points x months x dims, true subject of each point by month, expected events (month, kind, subject)) of a named world.

    Two subjects A and B of half the points each, ten apart; what changes is in the name: the
    centres drift, a tenth of B leaves for C from month 12, is C until month 18, A is one wide
    cloud until month 14 and two after (split) or the other way round (merge), or A and B
    come closer from month 12.
    """
    rng = np.random.Generator(np.random.PCG64([seed, WORLDS.index(name)]))
    half, few = points // 2, points // 20
    along = lambda x, y=0.0: np.array([x, y] + [0.0] * (dims - 2))
    z, truth = np.empty((points, months, dims)), []
    for m in range(months):
        who = np.array(["A"] * half + ["B"] * (points - half), dtype=object)
        where, spread = {"A": along(-5.0), "B": along(5.0)}, {}
        if name == "drift":
            where = {k: c + along(0.04 * m) for k, c in where.items()}
        elif name == "proximity" and m >= 12:
            gap = 5.0 - (5.0 - 0.35) * (m - 11) / 12
            where = {"A": along(-gap / 2), "B": along(gap / 2)}
        elif name in ("birth", "death") and (m >= 12 if name == "birth" else m < 18):
            who[half - few : half], where["C"] = "C", along(0.0, 5.0)
        elif name in ("split", "merge"):
            if (m >= 14) == (name == "split"):
                who[: half // 2], who[half // 2 : half] = "A1", "A2"
                where |= {"A1": along(-5.0, -2.0), "A2": along(-5.0, 2.0)}
            else:
                spread["A"] = 1.2
        for subject in np.unique(who):
            mine = who == subject
            z[mine, m] = rng.normal(where[subject], spread.get(subject, 0.3), (int(mine.sum()), dims))
        truth.append(who)
    expected = []
    for subject in sorted(set(np.concatenate(truth))):
        seen = [m for m, who in enumerate(truth) if subject in who]
        expected += [(seen[0], "birth", subject)] if seen[0] else []
        expected += [(seen[-1] + PATIENCE + 1, "disappearance", subject)] if seen[-1] + PATIENCE + 1 < months else []
    return z, truth, expected


def worlds(spark: SparkSession, names: tuple[str, ...] = WORLDS) -> DataFrame:
    """world, node, m, x, subject, label of the named worlds; each is made in one task, and its label numbers the subjects."""

    def make(frames):
        for frame in frames:
            for name in frame["world"]:
                z, truth, _ = world(name)
                number = {s: i for i, s in enumerate(sorted(set(np.concatenate(truth))))}
                for m, who in enumerate(truth):
                    yield pd.DataFrame({"world": name, "node": np.arange(len(who)), "m": m, "x": list(z[:, m]), "subject": who, "label": [number[s] for s in who]})

    return spark.createDataFrame([(n,) for n in names], "world string").repartition(len(names)).mapInPandas(make, "world string, node long, m int, x array<double>, subject string, label int")


def score_identities(events: DataFrame, subjects: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """world, tp, fp, fn, event_tp, event_fp, event_fn: recognitions and births and ends against the truth.

    subjects: world, m, label, subject (the subject of most of a cluster's rows). An identity
    stands for the subject of the cluster it began with, if it is that subject's first month. A true
    match is a subject seen before, no more than patience + 1 months ago.
    """

    def run(key, e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        is_ = {(r.m, r.label): r.subject for r in s.itertuples()}
        months = sorted(s["m"].unique())
        present = {m: set(s[s["m"] == m]["subject"]) for m in months}
        first = {}
        for m in months:
            for x in present[m]:
                first.setdefault(x, m)
        stands: dict[int, str] = {}
        for r in e[e["status"].isin(["initial", "birth", "birth_candidate"])].sort_values(["m", "label"]).itertuples():
            subject = is_[(r.m, r.label)]
            if first[subject] == r.m and subject not in stands.values():
                stands[r.identity] = subject
        count, last = dict.fromkeys(("tp", "fp", "fn", "event_tp", "event_fp", "event_fn"), 0), {x: months[0] for x in present[months[0]]}
        for _, m in pairwise(months):
            true = {x for x in present[m] if x in last and m - last[x] <= patience + 1}
            said = [(is_[(r.m, r.label)], stands.get(r.identity)) for r in e[(e["m"] == m) & e["status"].isin(["continuing", "reemergence"])].itertuples()]
            right = {a for a, b in said if a == b and a in true}
            count["tp"] += len(right)
            count["fp"] += len(said) - len(right)
            count["fn"] += len(true - right)
            last |= dict.fromkeys(present[m], m)
        wanted = {("birth", m, x) for x, m in first.items() if m > months[0]} | {("disappearance", last[x] + patience + 1, x) for x in last if last[x] + patience + 1 <= months[-1]}
        named = [("birth", r.m, is_[(r.m, r.label)]) for r in e[e["status"] == "birth"].itertuples()] + [("disappearance", r.m, stands.get(r.identity)) for r in e[e["status"] == "disappearance"].itertuples()]
        hit = wanted & set(named)
        count |= {"event_tp": len(hit), "event_fp": len(named) - len(hit), "event_fn": len(wanted - hit)}
        return pd.DataFrame([{"world": key[0], **count}])

    # months x clusters rows in a world
    return events.groupBy("world").cogroup(subjects.groupBy("world")).applyInPandas(run, "world string, tp long, fp long, fn long, event_tp long, event_fp long, event_fn long")
