"""Graphs, permutation nulls and consensus.

Draws are made from row keys, so they are reproducible and need no driver loop over rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.draws import draw
from ledgerline.operators import cluster as C
from ledgerline.operators.joins import squared_distance
from ledgerline.operators.sets import positions
from ledgerline.sources.durable import written


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, degree; nodes without an edge stay, with 0."""
    ends = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node")))
    n = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(n, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


#: A level ends when two rounds bring less than this share of what it has brought so far; the next level goes on from there.
LITTLE = 0.05
#: The least growth of modularity that counts.
GROWTH = 1e-12


def _settled(edges: DataFrame, start: DataFrame, two_w: float, resolution: float, little: float) -> tuple[DataFrame, bool]:
    """(u, l: nodes moved from the communities of start (u, l) to neighbouring ones, each round to a higher modularity; has any moved).

    In a round half of the communities (by hash) give nodes and the others take them, so none
    swap labels; each node goes where its gain is largest: the weight to a community less
    degree times the community's total degree over 2W, ties to the least label. Where all moves
    together don't raise modularity, only those are made that have the largest gain of both
    communities they touch: their gains add up. So each round is a rise, and the level ends by itself: when no
    single move is a gain, or two rounds bring less than little of the level's rise. Loops count in degrees.
    """
    both = edges.filter("u <> v").select("u", "v", "weight").unionByName(edges.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))
    both = written(both)
    loops = edges.filter("u = v").select("u", (F.lit(2) * F.col("weight")).alias("weight"))
    looped = loops.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    least = GROWTH * two_w / 2  # in units of weight

    def look(labels: DataFrame, i: int) -> tuple[DataFrame, float, int, int]:
        """(each node's community, best move and best move in this turn, modularity, numbers of both moves)."""
        links = both.join(labels.select(F.col("u").alias("v"), F.col("l").alias("to")), "v").select("u", "to", "weight")
        seen = links.unionByName(labels.select("u", F.col("l").alias("to"), F.lit(0.0).alias("weight"))).groupBy("u", "to").agg(F.sum("weight").alias("w"))
        size = labels.groupBy(F.col("l").alias("to")).agg(F.sum("d").alias("t"))
        own = F.col("to") == F.col("l")
        g = F.col("w") - resolution * F.col("d") * (F.col("t") - F.when(own, F.col("d")).otherwise(0.0)) / two_w
        move = F.struct(F.round("g", 12).alias("g"), (-F.col("to")).alias("m"))
        side = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(i)), F.lit(2))
        per = seen.join(size, "to").join(labels, "u").withColumn("g", g).groupBy("u").agg(
            F.any_value("l").alias("l"), F.any_value("d").alias("d"), F.max(F.when(own, F.round("g", 12))).alias("stay"), F.max(F.when(own, F.col("w"))).alias("inside"), F.max(F.when(own, F.col("t"))).alias("t"),
            F.max(F.when(~own, move)).alias("best"), F.max(F.when(~own & (side("l") == 0) & (side("to") == 1), move)).alias("turn"),
        )
        better = lambda c: F.when(F.col(c)["g"] > F.col("stay") + least, F.struct((F.col(c)["g"] - F.col("stay")).alias("g"), (-F.col(c)["m"]).alias("l")))
        state = written(per.select("u", "l", "d", "t", "inside", better("best").alias("best"), better("turn").alias("turn")))
        inside, square, n, turns = state.agg(F.sum("inside"), F.sum(F.col("d") * F.col("t")), F.count("best"), F.count("turn")).first()
        return state, ((inside or 0.0) + looped) / two_w - resolution * (square or 0.0) / two_w**2, n, turns

    def apart(state: DataFrame) -> DataFrame:
        """The moves with the largest gain of both communities, made."""
        moves = state.filter("best is not null").select("u", "l", F.col("best.l").alias("to"), F.struct(F.col("best.g"), (-F.col("u")).alias("m")).alias("p"))
        top = moves.select("l", "p").unionByName(moves.select(F.col("to").alias("l"), "p")).groupBy("l").agg(F.max("p").alias("top"))
        chosen = moves.join(top, "l").filter("p = top").select("u", "to", "p").join(top.withColumnRenamed("l", "to"), "to").filter("p = top").select("u", "to")
        return state.join(chosen, "u", "left").select("u", F.coalesce("to", "l").alias("l"), "d")

    degree = both.select("u", "weight").unionByName(loops).groupBy("u").agg(F.sum("weight").alias("d"))
    state, quality, n, turns = look(written(degree.join(start, "u").select("u", "l", "d")), 0)
    reached, i = [quality], 0
    while n:
        i += 1
        found = look(state.select("u", F.coalesce("turn.l", "l").alias("l"), "d"), i) if turns else None
        if found is None or found[1] <= quality + GROWTH:
            found = look(apart(state), i)
            if found[1] <= quality:
                break  # gains that doubles can't tell
        state, quality, n, turns = found
        reached.append(quality)
        if len(reached) > 3 and quality - reached[-3] < little * (quality - reached[0]):
            break
    return state.select("u", "l"), len(reached) > 1


def communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """node, community: Louvain levels over weighted edges (u, v, weight); a community is named by its least node.

    Nodes move while modularity grows, then communities become the nodes of a graph of their own, whose
    loops are the weight inside, until nothing joins any more. Then single nodes move again from there, till
    no move is a gain, and levels follow, until both leave all as it is. There is no limit of
    rounds: each raises modularity.
    """
    two_w = 2 * (edges.agg(F.sum("weight")).first()[0] or 0.5)
    whole = written(edges.select("u", "v", "weight"))
    nodes = written(whole.select("u").union(whole.select("v")).distinct().select(F.col("u").alias("node"), F.col("u").alias("at")))
    little = LITTLE  # the first time; what it leaves is settled by the next
    while True:
        graph, start, joined, level = whole, nodes.select(F.col("node").alias("u"), F.col("at").alias("l")), False, 0
        while True:
            found, moved = _settled(graph, start, two_w, resolution, LITTLE if level else little)
            if moved:
                names = written(found.groupBy("l").agg(F.min("u").alias("name")).join(found, "l").select("u", "name"))
                joined = joined or level > 0
            elif level:
                break
            else:
                names = start.select("u", F.col("l").alias("name"))
            # at level 0 a node's community is dealt anew, later it is that of its community
            held = nodes.select("node", F.col("node" if level == 0 else "at").alias("u"))
            nodes = written(held.join(names, "u").select("node", F.col("name").alias("at")))
            renamed = graph.join(names, "u").select(F.col("name").alias("a"), "v", "weight").join(names, F.col("v") == F.col("u")).select("a", F.col("name").alias("b"), "weight")
            graph = written(renamed.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("weight").alias("weight")))
            start = nodes.select(F.col("at").alias("u"), F.col("at").alias("l")).distinct()
            level += 1
        if not joined and not little:
            return nodes.select("node", F.col("at").alias("community"))
        little = 0.0


def penalised(x: DataFrame, centres: DataFrame, node: str, month: str, vector: str, penalty: float) -> DataFrame:
    """node, month, label: argmin of squared distance plus the penalty for leaving the label before; a fold along each node."""
    packed = centres.agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("_c"))  # clusters
    costs = x.join(F.broadcast(packed), how="cross").select(node, month, F.transform("_c", lambda c: F.struct(c["label"].alias("l"), squared_distance(F.col(vector), c["c"]).alias("d"))).alias("k"))
    per = costs.groupBy(node).agg(F.array_sort(F.collect_list(F.struct(F.col(month).alias("m"), "k"))).alias("s"))  # one entry a month
    kinds = f"{node} {x.schema[node].dataType.simpleString()}, {month} int, label int"

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, series in zip(rows[node], rows["s"], strict=True):
            last = None
            for s in series:
                d = [(k["d"] + (penalty if last is not None and k["l"] != last else 0.0), k["l"]) for k in s["k"]]
                last = min(d)[1]
                out.append((key, s["m"], last))
        return pd.DataFrame(out, columns=[node, month, "label"])

    return per.mapInPandas(lambda frames: (fold(f) for f in frames), kinds)


#: Nodes that are linked with one another through shares, at most, for consensus_cores().
LARGEST = 4000


def _core_labels(s: np.ndarray, least: float) -> np.ndarray:
    """Average linkage on the similarities s, merging while the two closest groups' mean is at least `least`."""
    s, size, of = s.copy(), np.ones(len(s)), np.arange(len(s))
    np.fill_diagonal(s, -np.inf)
    while len(s) > 1:
        i, j = sorted(divmod(int(np.argmax(s)), len(s)))
        if not s[i, j] >= least - 1e-12:
            break
        merged = (size[i] * s[i] + size[j] * s[j]) / (size[i] + size[j])
        merged[[i, j]] = -np.inf
        s[i, :], s[:, i] = merged, merged
        s[j, :], s[:, j] = -np.inf, -np.inf
        size[i] += size[j]
        of[of == j] = i
    return of


def consensus_cores(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """node, core, score: average linkage on co-association shares, merged while a pair of groups' mean share is at least `least`.

    A core is named by its least node; its score is the mean share inside, none for a lone node.
    Nodes without a share are apart from the start, so each component of the shares is linked by
    itself, in a task of its own; one of more than LARGEST nodes is refused.
    """
    part = C.components(pairs, "u", "v")
    kind = nodes.schema["node"].dataType.simpleString()

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(np.concatenate([rows["u"], rows["v"]]))
        if len(names) > LARGEST:
            raise ValueError(f"{len(names)} nodes in one component, {LARGEST} are allowed")
        s = np.eye(len(names))
        u, v = np.searchsorted(names, rows["u"]), np.searchsorted(names, rows["v"])
        s[u, v] = s[v, u] = rows["share"]
        of = _core_labels(s, least)
        out = []
        for g in np.unique(of):
            at = np.flatnonzero(of == g)
            n = len(at)
            score = float((s[np.ix_(at, at)].sum() - n) / (n * (n - 1))) if n > 1 else None
            out += [(names[i], names[at[0]], score) for i in at]
        return pd.DataFrame(out, columns=["node", "core", "score"])

    linked = pairs.join(part, F.col("u") == F.col("node")).select("component", "u", "v", "share").groupBy("component").applyInPandas(link, f"node {kind}, core {kind}, score double")
    return nodes.join(linked, "node", "left").select("node", F.coalesce("core", "node").alias("core"), "score")


def passports(df: DataFrame, key: str, label: str, vector: str, region: str, typical: int = 5, draws: int = 1000, seed: int = 13) -> DataFrame:
    """label, n, share, profile, radius, typical, regions, low, high: what a cluster is.

    profile is the mean vector, typical the members nearest to it (least key on a tie), regions the
    members by region; low and high bound 95 % of the profiles when regions, all of the
    table's, are drawn with replacement. Sums by cluster and region are what is drawn from.
    """
    c = C.centroids(df, label, vector)
    d = df.join(F.broadcast(c), label).withColumn("d", F.sqrt(squared_distance(C.as_double(vector), F.col("centre"))))  # clusters
    w = Window.partitionBy(label).orderBy("d", key)
    near = d.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= typical).groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", key))), lambda x: x[key]).alias("typical"))
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    basic = d.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.any_value("centre").alias("profile"), F.avg("d").alias("radius")).join(F.broadcast(total), how="cross")  # one row
    sums = df.select(label, region, F.posexplode(C.as_double(vector)).alias("i", "v")).groupBy(label, region, "i").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    counts = sums.filter("i = 0").groupBy(label).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(region).cast("string").alias("k"), "n")))).alias("regions"))  # regions
    names = sorted(r[0] for r in df.select(F.col(region).cast("string")).distinct().collect())  # regions
    kind = df.schema[label].dataType.simpleString()

    def interval(rows: pd.DataFrame) -> pd.DataFrame:
        at = {r: k for k, r in enumerate(names)}
        dims = int(rows["i"].max()) + 1
        s, n = np.zeros((len(names), dims)), np.zeros(len(names))
        for r, i, v, m in zip(rows[region].astype(str), rows["i"], rows["s"], rows["n"], strict=True):
            s[at[r], i] = v
            n[at[r]] = m
        times = np.random.Generator(np.random.PCG64(seed)).multinomial(len(names), np.full(len(names), 1 / len(names)), size=draws)
        weight = times @ n
        means = (times @ s)[weight > 0] / weight[weight > 0, None]
        low, high = np.quantile(means, [0.025, 0.975], axis=0)
        return pd.DataFrame({label: [rows[label].iloc[0]], "low": [low.tolist()], "high": [high.tolist()]})

    bounds = sums.groupBy(label).applyInPandas(interval, f"{label} {kind}, low array<double>, high array<double>")  # regions x dimensions
    out = basic.join(near, label).join(counts, label).join(bounds, label)
    return out.select(label, "n", (F.col("n") / F.col("_all")).alias("share"), "profile", "radius", "typical", "regions", "low", "high")


def dealt(df: DataFrame, key: str, strata: list[str], value: str, draws: int, seed: int) -> DataFrame:
    """draw (1 to draws), key, strata, value: the values dealt anew within each stratum, in every draw.

    Rows are numbered once by (strata, key), and once by (draw, strata, a draw for the row), both
    by ranges over many tasks; as the strata take the same numbers in both, equal numbers meet.
    """
    base = df.select(key, *strata, value)
    n = base.count()
    mine = positions(base.select(key, *strata), [F.asc(c) for c in [*strata, key]], "_at")
    each = base.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_h", draw(key, "draw", seed=seed))
    theirs = positions(each.select("draw", *strata, "_h", F.col(key).alias("_key"), value), [F.asc(c) for c in ["draw", *strata, "_h", "_key"]], "_place")
    theirs = theirs.select("draw", value, (F.col("_place") - (F.col("draw") - 1) * n).alias("_at"))
    return mine.join(theirs, "_at").select("draw", key, *strata, value)


def permuted(df: DataFrame, key: str, strata: list[str], value: str, seed: int) -> DataFrame:
    """df's key and strata with the values dealt anew within each stratum, once."""
    return dealt(df, key, strata, value, 1, seed).drop("draw")


def bootstrap_counts(keys: DataFrame, key: str, draws: int, seed: int = 37) -> DataFrame:
    """key, draw (1 to draws), times: as many keys as there are drawn with replacement; keys are drawn whole, those not drawn are left out."""
    n = keys.count()
    numbered = positions(keys.select(key), [F.asc(key)], "_at")
    slots = numbered.sparkSession.range(1, n * draws + 1).select(F.col("id"), (F.floor((F.col("id") - 1) / max(n, 1)) + 1).cast("int").alias("draw"))
    picked = slots.select("draw", (F.pmod(draw("id", seed=seed), F.lit(max(n, 1))) + 1).alias("_at")).groupBy("draw", "_at").agg(F.count(F.lit(1)).alias("times"))
    return picked.join(numbered, "_at").select(key, "draw", "times")


def partition_null(edges: DataFrame, labels: DataFrame, node: str, label: str, draws: int = 300, seed: int = 41) -> DataFrame:
    """observed share of weight inside clusters, its mean and spread when labels are dealt anew, and z; all draws in one join."""
    plain = labels.select(F.lit(0).alias("draw"), node, label)
    each = plain.unionByName(dealt(labels, node, [], label, draws, seed))
    e = edges.join(each.select("draw", F.col(node).alias("u"), F.col(label).alias("lu")), "u").join(each.select("draw", F.col(node).alias("v"), F.col(label).alias("lv")), ["draw", "v"])
    per = e.groupBy("draw").agg((F.sum(F.when(F.col("lu") == F.col("lv"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("s"))
    s = per.agg(F.max(F.when(F.col("draw") == 0, F.col("s"))).alias("observed"), F.avg(F.when(F.col("draw") > 0, F.col("s"))).alias("mean"), F.stddev_pop(F.when(F.col("draw") > 0, F.col("s"))).alias("spread"))
    return s.withColumn("z", (F.col("observed") - F.col("mean")) / F.nullif("spread", F.lit(0.0)))


def moran_null(values: DataFrame, neighbours: DataFrame, node: str, value: str, draws: int, seed: int = 43) -> DataFrame:
    """observed, p: Moran's I and the share of permutations at least as large, the observed one counted in."""
    whole = values.agg(F.avg(value).alias("_m"), F.count(F.lit(1)).alias("_n"), F.var_pop(value).alias("_v"))  # the same in every draw
    each = values.select(F.lit(0).alias("draw"), node, value).unionByName(dealt(values, node, [], value, draws, seed))
    z = each.join(F.broadcast(whole.select("_m")), how="cross").select("draw", F.col(node).alias("_id"), (F.col(value) - F.col("_m")).alias("z"))  # one row
    inverse = 1 / F.greatest("d", F.lit(1e-12))
    e = neighbours.withColumn("w", inverse / F.sum(inverse).over(Window.partitionBy("node")))
    e = e.join(z.select(F.col("_id").alias("node"), "draw", F.col("z").alias("za")), "node").join(z.select(F.col("_id").alias("other"), "draw", F.col("z").alias("zb")), ["other", "draw"])
    i = e.groupBy("draw").agg((F.sum(F.col("w") * F.col("za") * F.col("zb")) / F.sum("w")).alias("i")).join(F.broadcast(whole), how="cross").select("draw", (F.col("i") / F.col("_v")).alias("moran"))  # one row
    top = F.max(F.when(F.col("draw") == 0, F.col("moran"))).over(Window.partitionBy(F.lit(0)))  # one row a draw
    return i.withColumn("observed", top).agg(F.max("observed").alias("observed"), (F.count_if(F.col("moran") >= F.col("observed") - 1e-12) / F.count(F.lit(1))).alias("p"))


def holm(df: DataFrame, key: str, p: str) -> DataFrame:
    """key, adjusted: Holm's step-down p values over the listed tests."""
    w = Window.partitionBy(F.lit(0)).orderBy(p, key)  # the tests: few
    r = df.withColumns({"_i": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})
    step = (F.col("_n") - F.col("_i") + 1) * F.col(p)
    return r.withColumn("_s", step).select(key, F.least(F.max("_s").over(Window.partitionBy(F.lit(0)).orderBy("_i")), F.lit(1.0)).alias("adjusted"))

