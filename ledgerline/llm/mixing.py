"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in a reproducible shuffle, are cut into blocks. With target weight w,
the i-th block (from 1) of a source is released at slot floor((i-1)/w) and due by slot
ceil(i/w); the earliest deadline among the released blocks goes next. With weights that
sum to one every deadline is met, so after any number of slots no source is a whole block
away from its target.

Weights are exact: a weight is the rational number that its float is, releases and deadlines
are whole-number arithmetic on them, so nothing drifts however long the table. The driver
runs the schedule once, block by block, and keeps three numbers for each block, not row;
blocks double in size until there are BLOCKS of them at most, so this is bounded too.
When a source runs out its phase ends, and the sources left share the next phase in
proportion to their weights; so every row is scheduled, in at most as many phases as there
are sources.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import BROADCAST_IDS, attach, bounded_batches, materialise, number_rows, table

#: Rows of a block, unless there would be more than BLOCKS of them.
BLOCK, BLOCKS = 64, 1 << 22
#: Targets, where none are given, go with this power of a source's number of rows.
POWER = 0.5


def exact(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportion of the weights."""
    ratios = [Fraction(w) for w in weights]
    scale = math.lcm(*(r.denominator for r in ratios))
    out = [int(r * scale) for r in ratios]
    common = math.gcd(*out)
    return [x // common for x in out]


def shares(weights: list[float], period: int) -> list[int]:
    """Whole shares of the period, at least 1 each, by largest remainder; ties go to the earlier."""
    period = max(period, len(weights))
    total = sum(weights)
    ideal = [w / total * period for w in weights]
    out = [max(1, int(x)) for x in ideal]
    while sum(out) < period:
        out[max(range(len(out)), key=lambda i: (ideal[i] - out[i], -i))] += 1
    while sum(out) > period:
        out[max((i for i in range(len(out)) if out[i] > 1), key=lambda i: (out[i] - ideal[i], -i))] -= 1
    return out


class Schedule:
    """The slot of every block of lanes with these weights and numbers of blocks.

    A period, if given, rounds the weights of each phase to whole shares of so many slots.
    """

    def __init__(self, weights: list[float], blocks: list[int], period: int | None = None):
        self.begin = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)  # first block of each lane in the arrays
        self.slot, self.release, self.deadline = (np.zeros(int(self.begin[-1]), np.int64) for _ in range(3))
        self.starts: list[int] = []  # first slot of each phase
        self._shares: list[tuple[int, dict[int, int] | None]] = []  # (size, shares where they are rounded) of each phase
        done = [0] * len(blocks)
        begin = self.begin.tolist()
        lanes = [s for s, n in enumerate(blocks) if n]
        whole = dict(zip(lanes, exact([weights[s] for s in lanes]), strict=True)) if lanes and not period else {}
        self._whole = whole
        start = 0
        while lanes:
            share = dict(zip(lanes, shares([weights[s] for s in lanes], period), strict=True)) if period else whole
            size = sum(share[s] for s in lanes)
            first = {s: done[s] for s in lanes}
            ready = [(-(-size // share[s]), s, 0) for s in lanes]  # (deadline, lane, release) of the next block, if released
            heapq.heapify(ready)
            later: list[tuple[int, int, int]] = []  # (release, deadline, lane)
            t = 0
            while True:
                while later and later[0][0] <= t:
                    release, deadline, s = heapq.heappop(later)
                    heapq.heappush(ready, (deadline, s, release))
                deadline, s, release = ready[0]
                if done[s] == blocks[s]:
                    break
                at = begin[s] + done[s]
                self.slot[at], self.release[at], self.deadline[at] = start + t, start + release, start + deadline
                done[s] += 1
                i, q = done[s] - first[s], share[s]
                release, deadline = i * size // q, -(-(i + 1) * size // q)
                t += 1
                if release <= t:
                    heapq.heapreplace(ready, (deadline, s, release))
                else:
                    heapq.heappop(ready)
                    heapq.heappush(later, (release, deadline, s))
            self.starts.append(start)
            self._shares.append((size, share if period else None))
            start += t
            lanes = [s for s in lanes if done[s] < blocks[s]]
        self.slots = start

    @property
    def phases(self) -> Iterator[tuple[int, dict[int, tuple[int, int]], int, int]]:
        """(first slot, {lane: (first block, share)}, sum of shares, slots) of each phase."""
        for p, (start, (size, share)) in enumerate(zip(self.starts, self._shares, strict=True)):
            share = share or self._whole
            had = {s: int(np.searchsorted(self.slot[self.begin[s] : self.begin[s + 1]], start)) for s in share}
            places = {s: (had[s], q) for s, q in share.items() if had[s] < self.begin[s + 1] - self.begin[s]}
            yield start, places, size, (self.starts[p + 1] if p + 1 < len(self.starts) else self.slots) - start

    def place(self, lane: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, ...]:
        """(phase, slot, release, deadline) of blocks; release and deadline are global slots."""
        at = self.begin[lane] + block
        slot = self.slot[at]
        return np.searchsorted(np.array(self.starts, np.int64), slot, side="right") - 1, slot, self.release[at], self.deadline[at]


def block_size(rows: int) -> int:
    """BLOCK, doubled until the rows of all lanes make BLOCKS blocks at most (and one more for each lane)."""
    size = BLOCK
    while rows // size > BLOCKS:
        size *= 2
    return size


def _numbered(docs: DataFrame, weights: dict[str, float] | None, block: int | None, period: int | None) -> tuple[DataFrame, Schedule, np.ndarray, Callable[[DataFrame], DataFrame], int]:
    """(rows with lane and row number in lane order, schedule, first row number of each lane, how a table gets its lanes, rows of a block)."""
    spark = docs.sparkSession
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        # every source has a lane, the largest first; names stay in the table, the driver gets one number a source
        placed, n_named = number_rows(counts.withColumn("_neg", -F.col("n")), ["_neg", "source"])
        lanes = materialise(placed.select("source", F.col("rn").cast("int").alias("_lane"), "n"), "lanes")
        rows = lanes.orderBy("_lane").select("n").toPandas()["n"].tolist()
        target = [n**POWER for n in rows]
    else:
        names = sorted((k for k in weights if k != ""), key=lambda k: (k is not None, k or ""))
        n_named, rows = len(names), []
        target = [float(weights[k]) for k in names]
        target.append(weights.get("", min(target, default=1.0)))
        lanes = spark.createDataFrame([(n, i, 0) for i, n in enumerate(names)], "source string, _lane int, n long")

    def laned(df: DataFrame) -> DataFrame:
        key = {"_absent": F.col("source").isNull(), "_source": F.coalesce("source", F.lit(""))}
        groups = lanes.select(*(c.alias(k) for k, c in key.items()), "_lane", F.col("n").alias("_n"))
        by = df.withColumns(key)
        found = by.join(F.broadcast(groups), list(key), "left") if n_named <= BROADCAST_IDS else attach(by, groups, list(key), "_n", sum(rows))
        return found.withColumn("lane", F.coalesce("_lane", F.lit(n_named))).drop(*key, "_lane", "_n")

    if weights is not None:
        sizes = {r["lane"]: r["n"] for r in laned(counts).groupBy("lane").agg(F.sum("n").alias("n")).collect()}
        rows = [sizes.get(i, 0) for i in range(n_named + 1)]
    narrow = laned(docs.select("doc_id", "source")).withColumn("_order", F.xxhash64("doc_id"))
    numbered, _ = number_rows(narrow, ["lane", "_order", "doc_id"])
    starts = np.concatenate([[0], np.cumsum(rows)]).astype(np.int64)
    block = block or block_size(sum(rows))
    schedule = Schedule([max(t, 1e-12) for t in target], [-(-n // block) for n in rows], period)
    return numbered, schedule, starts, laned, block


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int | None = None, period: int | None = None) -> tuple[DataFrame, Schedule]:
    """(plan, schedule). plan: doc_id, source, lane, block, place, phase, slot, release, deadline; one row per row of docs.

    weights: target weight of each source; sources without one share a last lane of weight
    `weights[""]`, or the least given. Without weights, every source has a lane, and
    its target is its number of rows to the power POWER.
    A period, if given, rounds the weights to whole shares of so many slots.
    block: rows of a block; by default block_size().
    A null source is a source of its own, named by null. Rows without doc_id share one key, so
    they are sorted in one task. Rows of the whole order are sorted
    by (slot, place); repeated rows each have a place; an empty table gives an empty plan.
    """
    numbered, schedule, starts, _, block = _numbered(docs.select("doc_id", "source"), weights, block, period)

    @F.pandas_udf("phase int, slot long, release long, deadline long, block long, place int")
    def placed(lane: pd.Series, rn: pd.Series) -> pd.DataFrame:
        s = lane.to_numpy()
        i = rn.to_numpy() - starts[s]
        phase, slot, release, deadline = schedule.place(s, i // block)
        return pd.DataFrame({"phase": phase.astype(np.int32), "slot": slot, "release": release, "deadline": deadline, "block": i // block, "place": (i % block).astype(np.int32)})

    plan = numbered.withColumn("p", placed("lane", "rn"))
    return plan.select("doc_id", "source", "lane", "p.block", "p.place", "p.phase", "p.slot", "p.release", "p.deadline"), schedule


def in_mixed_order(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """docs, all rows and columns, dealt and sorted by their place in the mix.

    The partitions, and so the files written from them, are consecutive stretches of the
    schedule, as many as there are shuffle partitions. A stretch holds a run of each lane's order, so the first key of each lane in
    each stretch (lanes x partitions in number) tells every row its partition, and a row's
    place follows from its rank in its run: the texts are shuffled once and joined with
    nothing. Rows that share a doc_id, or have none, stand together; a null source is a source; texts
    aren't looked at; an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    numbered, schedule, starts, laned, block = _numbered(docs, weights, None, None)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = max(schedule.slots, 1)

    def part_at(lane: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return schedule.place(lane, rank // block)[1] * parts // total

    @F.pandas_udf("int")
    def stretch(lane: pd.Series, rn: pd.Series) -> pd.Series:
        s = lane.to_numpy()
        return pd.Series(part_at(s, rn.to_numpy() - starts[s]).astype(np.int32))

    first = numbered.groupBy("lane", "_order").agg(F.min("rn").alias("rn")).withColumn("part", stretch("lane", "rn"))
    runs = first.groupBy("lane", "part").agg(F.min("_order").alias("key"), F.min("rn").alias("rn")).collect()
    of_lane: dict[int, list[tuple[int, int, int]]] = {}
    for r in runs:
        of_lane.setdefault(r["lane"], []).append((r["key"], r["part"], r["rn"] - int(starts[r["lane"]])))
    tables_ = {lane: tuple(np.array(x, np.int64) for x in zip(*sorted(v), strict=True)) for lane, v in of_lane.items()}

    @F.pandas_udf("int")
    def dealt_to(lane: pd.Series, order: pd.Series) -> pd.Series:
        s, key = lane.to_numpy(), order.to_numpy()
        out = np.zeros(len(s), np.int32)
        by = np.argsort(s, kind="stable")
        for at in np.split(by, np.flatnonzero(np.diff(s[by])) + 1) if len(s) else ():
            keys, to, _ = tables_[s[at[0]]]
            out[at] = to[np.maximum(np.searchsorted(keys, key[at], side="right") - 1, 0)]
        return pd.Series(out)

    rows = laned(docs.select("doc_id", "source", F.struct(*docs.columns).alias("_row"))).withColumn("_order", F.xxhash64("doc_id"))
    dealt = rows.withColumn("_part", dealt_to("lane", "_order")).repartitionById(parts, F.col("_part")).sortWithinPartitions("_part", "lane", "_order", "doc_id")
    # rank within the run of a lane: rows of a partition arrive in that order
    ids = dealt.select("lane", "_part", F.monotonically_increasing_id().alias("_id"), "_row")

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, begun = None, 0
        for batch in batches:
            lane, part, rid = (batch.column(i).to_numpy() for i in range(3))
            slot, place = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
            edges = np.flatnonzero(np.concatenate([[True], (lane[1:] != lane[:-1]) | (part[1:] != part[:-1])])) if len(lane) else np.zeros(0, np.int64)
            for a, b in zip(edges, [*edges[1:], len(lane)], strict=True):
                if run != (lane[a], part[a]):
                    run, begun = (lane[a], part[a]), rid[a]
                _, to, ranks = tables_[run[0]]
                rank = ranks[np.flatnonzero(to == run[1])[0]] + rid[a:b] - begun
                slot[a:b] = schedule.place(lane[a:b], rank // block)[1]
                place[a:b] = rank % block
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(slot), pa.array(place)], names=["_row", "_slot", "_place"])

    schema = T.StructType([T.StructField("_row", docs.schema), T.StructField("_slot", T.LongType()), T.StructField("_place", T.LongType())])
    return ids.mapInArrow(ranked, schema).sortWithinPartitions("_slot", "_place").select("_row.*")


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))[0].drop("lane")
