"""Operators on hand-made inputs with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text
from ledgerline.functions.formula import evaluate
from ledgerline.functions.stats import mad
from ledgerline.operators import aggregates as A
from ledgerline.operators import checks, cluster, detect, forecast, joins, windows
from ledgerline.operators import panel as P
from ledgerline.sources import api, tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    "a, b, ari, nmi",
    [([0, 0, 1, 1], [1, 1, 0, 0], 1.0, 1.0), ([0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 2, 2], 0.24242424242424246, 0.5158037429793888), ([0, 0, 1, 1], [0, 1, 0, 1], -0.5, 0.0)],
)
def test_agreement(spark, a, b, ari, nmi):
    df = frame(spark, list(zip(a, b, strict=True)), "a int, b int")
    assert A.adjusted_rand(df, "a", "b").first()[0] == pytest.approx(ari)
    assert A.normalised_information(df, "a", "b").first()[0] == pytest.approx(nmi)


def test_network_indices(spark):
    edges = frame(spark, [(0, 1, 2.0), (2, 3, 2.0), (1, 2, 1.0)], "u long, v long, weight double")
    labels = frame(spark, [(0, 0), (1, 0), (2, 1), (3, 1)], "n long, l int")
    r = cluster.network_indices(edges, labels, "n", "l").first()
    assert (r.avi, r.avu, r.anui, r.q) == pytest.approx((0.8, 1.0, 4 / 9, 0.3))
    cliques = [(i, j, 1.0) for g in (0, 6) for i in range(g, g + 6) for j in range(i + 1, g + 6)]
    r = cluster.network_indices(frame(spark, cliques, "u long, v long, weight double"), frame(spark, [(i, i // 6) for i in range(12)], "n long, l int"), "n", "l").first()
    assert (r.avi, r.avu, r.anui, r.q) == pytest.approx((1.0, 0.0, 1.0, 0.5))


def test_leave_one_out_median(spark):
    rng = np.random.default_rng(4)
    rows = [(g, i, float(v)) for g, n in enumerate((1, 2, 3, 6, 7, 8)) for i, v in enumerate(rng.integers(0, 3, n))]
    got = {(r.g, r.i): r.loo for r in A.leave_one_out_median(frame(spark, rows, "g int, i int, v double"), ["g"], "v", "i").collect()}
    for g, i, _ in rows:
        rest = [v for h, j, v in rows if h == g and j != i]
        assert got[(g, i)] == (float(np.median(rest)) if rest else None)


def test_calendar_gap_is_not_closed(spark):
    from ledgerline.functions.calendar import at_lag

    df = frame(spark, [(1, 0, 1.0), (1, 1, 2.0), (1, 3, 4.0)], "k int, m int, value double").withColumn("b", at_lag("value", 1, ["k"]))
    assert {r.m: r.b for r in df.collect()} == {0: None, 1: 1.0, 3: None}


def test_persistence(spark):
    rows = [(1, 6, True, 1.0), (1, 7, False, 1.0), (1, 8, True, 1.0), (2, 6, True, 1.0), (2, 7, True, -1.0), (2, 8, True, 1.0), (3, 6, True, 1.0), (3, 7, True, 2.0), (3, 8, True, 1.0)]
    df = frame(spark, rows, "k int, m int, hot boolean, g double").withColumn("a", windows.persistent_same_sign("hot", "g", ["k"], 3))
    assert {r.k for r in df.filter("a").collect()} == {3}


def test_cooldown_is_greedy(spark):
    df = frame(spark, [(1, m) for m in (0, 1, 3, 4, 5, 8, 20)], "k int, m int")
    assert sorted(r.m for r in windows.cooldown(df, ["k"], 4).collect()) == [0, 4, 8, 20]


def test_conflict_aware(spark):
    df = frame(spark, [(1, 3), (1, 3), (2, None), (2, 4), (5, 3), (5, 4)], "k int, v int")
    got = {r.k: (r.v, r.status) for r in checks.conflict_aware(df, ["k"], "v").collect()}
    assert got == {1: (3, "ok"), 2: (4, "ok"), 5: (None, "conflict")}


def test_forward_and_greedy_matches(spark):
    alarms = frame(spark, [("a", 7), ("b", 8), ("c", 6), ("d", 9)], "k string, m int")
    onsets = frame(spark, [(k, 7) for k in "abcde"], "k string, onset int")
    got = {r.k: (r.hit, r.delay) for r in detect.forward_hits(alarms, onsets, ["k"], 1).collect()}
    assert got == {"a": (True, 0), "b": (True, 1), "c": (False, None), "d": (False, None), "e": (False, None)}
    one = detect.greedy_match(frame(spark, [("a", 5)], "k string, m int"), frame(spark, [("a", 4), ("a", 5)], "k string, onset int"), ["k"], 1)
    assert [(r.onset, r.m) for r in one.collect()] == [(4, 5)]


def test_forecast_fixture(spark):
    rows = [(t, "c", 23 + j, float(f * (10 + j))) for j in range(25) for t, f in ((1, 2), (2, 1), (3, 1))]
    panel = frame(spark, rows, "tid long, cat string, m int, value double")
    last = 23 + 24
    # own = 2 (10 + j), median = 10 + j: own at the origin times the median's move a year before
    want = 2 * (10 + 23) * (10 + 12) / (10 + 11)
    b = forecast.base(panel, ["tid", "cat"], "cat", 1).withColumn("p", F.col("yo") * forecast.seasonal_ratio())
    assert b.filter(f"tid = 1 and m = {last}").first().p == pytest.approx(want)
    s = forecast.conditional_ses(panel, ["tid", "cat"], "cat", 1).filter(f"tid = 1 and m = {last}").first()
    assert s.predicted == pytest.approx(want)
    assert [x.tolist() for x in forecast.best_levels(np.array([2.0, 2.0, 2.0]))] == [[2.0] * 3, [0.05] * 3]


@pytest.mark.parametrize("method", ["conditional_ses", "profile_ses"])
def test_later_values_change_no_forecast(spark, method):
    rng = np.random.default_rng(2)
    rows = [(t, "c", m, float(v)) for t in range(3) for m, v in enumerate(rng.uniform(50, 90, 30))]
    panel = frame(spark, rows, "tid long, cat string, m int, value double")
    run = lambda df: {(r.tid, r.m): r.predicted for r in getattr(forecast, method)(df, ["tid", "cat"], "cat", 2).collect() if r.m <= 24}
    changed = panel.withColumn("value", F.when(F.col("m") > 22, F.col("value") * 7).otherwise(F.col("value")))
    assert run(panel) == run(changed)


def test_detectors_look_only_back(spark):
    rng = np.random.default_rng(6)
    rows = [(1, m, float(v)) for m, v in enumerate(rng.uniform(50, 90, 40))]
    df = frame(spark, rows, "k int, m int, value double")
    later = df.withColumn("value", F.when(F.col("m") > 30, F.col("value") * 5).otherwise(F.col("value")))
    ph = lambda d: [tuple(r) for r in detect.page_hinkley(d, ["k"], "m", "value").filter("m <= 30").orderBy("m").collect()]
    assert ph(df) == ph(later)


def test_ridge_equals_augmented_least_squares(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 3)) * [1, 5, 0.2] + [0, 3, 1]
    y = x @ [1.0, -0.5, 2.0] + rng.normal(size=60)
    df = frame(spark, [(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    got = forecast.ridge(df, ["a", "b", "c"], "y", 0.3)
    z = (x - x.mean(0)) / x.std(0)
    design = np.vstack([z / np.sqrt(60), np.sqrt(0.3) * np.eye(3)])
    beta = np.linalg.lstsq(design, np.concatenate([(y - y.mean()) / np.sqrt(60), np.zeros(3)]), rcond=None)[0] / x.std(0)
    assert got == pytest.approx(np.concatenate([[y.mean() - x.mean(0) @ beta], beta]))


def test_as_of_ignores_unknown_availability(spark):
    q = frame(spark, [(1, 10), (1, 4), (2, 5)], "k int, at int")
    known = frame(spark, [(1, 5, 100), (1, None, 200), (1, 9, 300), (2, 6, 400)], "k int, avail int, v int")
    got = {(r.k, r["at"]): r.v for r in joins.as_of(q, known, ["k"], "at", "avail", ["v"]).collect()}
    assert got == {(1, 10): 300, (1, 4): None, (2, 5): None}


def test_asserted_join_refuses_repeats(spark):
    a, b = frame(spark, [(1,), (1,)], "k int"), frame(spark, [(1, 2)], "k int, v int")
    assert joins.asserted(a, b, ["k"], "left", "many_to_one").count() == 2
    with pytest.raises(Exception, match="left keys repeat"):
        joins.asserted(a, b, ["k"]).collect()


def test_mutual_neighbours_keep_isolated_nodes(spark):
    from ledgerline.operators.neighbours import nearest_vectors
    from ledgerline.operators.network import degrees

    df = frame(spark, [(101, [0.0]), (202, [0.1]), (303, [50.0])], "id long, x array<double>")
    edges = joins.mutual(nearest_vectors(df, "id", "x", 1), "node", "other")
    assert [tuple(r) for r in edges.collect()] == [(101, 202)]
    assert {r.node: r.degree for r in degrees(edges, df.select(F.col("id").alias("node"))).collect()} == {101: 1, 202: 1, 303: 0}


def test_neighbours_match_brute_force(spark):
    from ledgerline.operators.neighbours import nearest_vectors
    from ledgerline.operators.peers import nearest_on_line

    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (80, 3)).astype(float)
    got = {(r.node, r["rank"]): r.other for r in nearest_vectors(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>"), "id", "x", 4, block=16).collect()}
    for i in range(80):
        order = sorted((round(float(((x[i] - x[j]) ** 2).sum()), 9), j) for j in range(80) if j != i)
        assert [got[(i, k + 1)] for k in range(4)] == [j for _, j in order[:4]]
    line = {}
    for r in nearest_on_line(frame(spark, [(i, float(v[0])) for i, v in enumerate(x)], "id long, x double"), "id", "x", 3, width=3).collect():
        line.setdefault(r.id, set()).add(r.peer)
    for i in range(80):
        assert line[i] == {j for _, j in sorted((abs(x[i][0] - x[j][0]), j) for j in range(80) if j != i)[:3]}


def test_components_and_label_matching(spark):
    edges = frame(spark, [(i, i + 1) for i in range(0, 30) if i != 17] + [(40, 50)], "a long, b long")
    got = {r.node: r.component for r in cluster.components(edges, "a", "b").collect()}
    assert {got[i] for i in range(18)} == {0} and {got[i] for i in range(18, 31)} == {18} and got[50] == 40
    rng = np.random.default_rng(1)
    from itertools import permutations

    cost = rng.random((5, 5))
    at = cluster.match_labels(cost)
    assert cost[range(5), at].sum() == pytest.approx(min(cost[range(5), list(p)].sum() for p in permutations(range(5))))


def test_agglomeration_separates_groups():
    x = np.concatenate([np.zeros((5, 2)), np.ones((4, 2)) * 9, np.ones((3, 2)) * [0, 9]]) + np.random.default_rng(0).normal(size=(12, 2)) * 0.1
    for method in ("ward", "average"):
        labels = cluster.agglomerate(x, 3, method)
        assert len({tuple(labels[a:b]) for a, b in ((0, 5), (5, 9), (9, 12))}) == 3 and len(set(labels)) == 3


def test_formula_and_names(spark):
    one = spark.range(1).select(evaluate("(A1 - 2) * 3 / B1", {"A1": F.lit(4).cast("decimal(20,6)"), "B1": F.lit(4).cast("decimal(20,6)")}).alias("v"), text.name_key(F.lit("  ОРЁЛ,  область ")).alias("k"), text.name_key(F.lit("область орел")).alias("l")).first()
    assert float(one.v) == 1.5 and one.k == one.l
    for bad in ("__import__('os')", "A1 ** 2", "C9", "A1 if 1 else 2"):
        with pytest.raises((ValueError, SyntaxError)):
            evaluate(bad, {"A1": F.lit(1)})


def test_requests_are_checked(spark, root):
    with pytest.raises(ValueError):
        tables.scan(spark, root, "../orders")
    with pytest.raises(ValueError):
        tables.select(spark, root, "orders", ["nope"])
    with pytest.raises(ValueError):
        tables.select(spark, root, "lineitem", ["l_tax"], required=("l_suppkey",))
    with pytest.raises(ValueError):
        tables.guarded(tables.scan(spark, root, "nation"), 3)
    for wrong in ({"tool": "sql"}, {"tool": "rows", "dataset": "region"}, {"tool": "describe", "dataset": 3}, {"tool": "describe", "dataset": "region", "path": "/"}):
        with pytest.raises(ValueError):
            api.call(spark, root, **wrong)
    assert [r.columns for r in api.call(spark, root, "describe", dataset="region").collect()] == ["r_regionkey,r_name"]


def test_mad_and_resume(spark):
    df = frame(spark, [(1, float(v)) for v in (1, 2, 3, 4, 100)], "k int, v double")
    assert tuple(mad(df, "v", ["k"]).first()) == (1, 3.0, 1.4826)
    assert checks.fingerprint(df) == checks.fingerprint(df.orderBy(F.desc("v"))) != checks.fingerprint(df.limit(2))


def test_complete_grid(spark):
    df = frame(spark, [("a", 1, 1.0), ("a", 2, 1.0), ("b", 1, 1.0)], "k string, m int, value double")
    assert {r.k for r in P.complete(df, ["k"], ["m"], 2).collect()} == {"a"}
    assert {r.k: r.status for r in P.completeness(df, ["k"], ["m"], 2).collect()} == {"a": "complete", "b": "missing cells"}


def test_identities_recovered(spark):
    from ledgerline.operators import identities as I

    found = I.regions(I.worlds(spark, ("drift",)), "m", "label", "x", ["world"])
    thresholds = spark.createDataFrame([(0.3, 0.05, 0.1)], "keep double, margin double, floor double")
    events = I.follow(found, "m", "label", thresholds, ["world"])
    names = events.groupBy("label").agg(F.count_distinct("identity").alias("n"), F.count(F.lit(1)).alias("months")).collect()
    assert [(r.n, r.months) for r in names] == [(1, 24)] * 2 and {r.status for r in events.collect()} == {"initial", "continuing"}


@pytest.mark.parametrize("method", ["ward", "average"])
def test_linkage_is_plain_beyond_the_micro_clusters(spark, method):
    from ledgerline.operators import cluster as C

    x = np.random.default_rng(3).normal(size=(260, 3))
    labels = C.linkage_labels(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>"), "id", "v", 6, method)
    got = [r.label for r in labels.orderBy("id").collect()]
    assert got == C.agglomerate(x, 6, method).tolist()


def test_ward_of_centres_counts_their_sizes():
    from ledgerline.operators import cluster as C

    x = np.array([[0.0], [1.0], [2.1]])
    assert C.agglomerate(x, 2, "ward", np.array([50, 50, 1])).tolist() == [0, 1, 1]
    assert C.agglomerate(x, 2, "ward").tolist() == [0, 0, 1]


def test_mixture_sees_every_dimension(spark):
    from ledgerline.operators import cluster as C

    x = np.random.default_rng(3).normal(size=(200, 64))
    x[100:, 63] += 40
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>")
    got = [r.label for r in C.mixture(rows, "id", "v", 2).orderBy("id").collect()]
    assert len(set(got[:100])) == len(set(got[100:])) == 1 and got[0] != got[-1]


def test_peers_are_those_of_all_pairs(spark):
    from ledgerline.operators.peers import peers

    rng = np.random.default_rng(9)
    rows = [(i, int(k), None if k == 3 else "n", float(s)) for i, (k, s) in enumerate(zip(rng.integers(0, 4, 300), np.round(rng.choice([1.0, 40.0], 300) * rng.integers(1, 60, 300) / 8, 2), strict=True))]
    rows += [(300 + i, 9, "n", v) for i, v in enumerate([None, 0.0, 0.0, -3.0, -4.0, 7.0])]
    df = frame(spark, rows, "id long, kind int, nation string, size double")
    for k, least, width in ((3, 2, 7), (2, 5, 10_000)):
        got = {}
        for r in peers(df, "id", ["kind", "nation"], "size", 0.5, 2.0, k, least, width=width).collect():
            got.setdefault(r.id, []).append((r["rank"], r.peer, r.d, r.status))
        for i, kind, nation, s in rows:
            near = sorted((abs(s - t), j) for j, o, n, t in rows if None not in (s, t, n, nation) and j != i and (o, n) == (kind, nation) and 0.5 * s <= t <= 2 * s)
            want = [(at + 1, j, d, "ok") for at, (d, j) in enumerate(near[:k])] if len(near) >= least else [(None, None, None, "unsupported")]
            assert sorted(got[i], key=str) == want
    with pytest.raises(ValueError, match="must hold"):
        peers(df, "id", ["kind"], "size", 1.5, 2.0, 3, 1)


def test_peers_of_a_large_kind_form_no_pairs(spark):
    from ledgerline.operators.peers import peers

    # all of one kind and nearly one size: a row meets a few candidates, not the rows of its kind
    same = spark.range(3000).select("id", F.lit(1).alias("kind"), (100 + F.col("id") % 50).cast("double").alias("size"))
    out = peers(same, "id", ["kind"], "size", 0.5, 2.0, 5, 2)
    assert len(out.collect()) == 15_000

    def made(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return made(node.executedPlan())
        below = [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        own = [node.metrics().apply("numOutputRows").value()] if node.metrics().contains("numOutputRows") else []
        return sum(map(made, below), own)

    assert max(made(out._jdf.queryExecution().executedPlan())) <= 15_000
