"""Clusterings, graphs, identities and nulls against plain versions."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.functions.draws import draw
from ledgerline.operators import cluster as C
from ledgerline.operators import identities as I
from ledgerline.operators import network as N
from ledgerline.plans.catalog import QUERIES


def points(spark, x, **more):
    names = ["id", *more]
    kinds = "".join(f", {n} {'int' if isinstance(v[0], (int, np.integer)) else 'string'}" for n, v in more.items())
    rows = [(i, *(v[i].item() if hasattr(v[i], "item") else v[i] for v in more.values()), r.tolist()) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, f"{names[0]} long{kinds}, x array<double>")


def blobs(n=30, k=3, dims=4, seed=1):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(rng.normal(size=dims) * 8, 1.0, (n, dims)) for _ in range(k)])


def plain_linkage(x, k, method):
    """Every pair of groups compared by its definition, in every step."""
    groups = [[i] for i in range(len(x))]

    def distance(a, b):
        p, q = x[a], x[b]
        if method == "average":
            return np.sqrt(((p[:, None] - q[None]) ** 2).sum(-1)).mean()
        return len(a) * len(b) / (len(a) + len(b)) * ((p.mean(0) - q.mean(0)) ** 2).sum()

    while len(groups) > k:
        i, j = min(combinations(range(len(groups)), 2), key=lambda p: distance(groups[p[0]], groups[p[1]]))
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("method", ["ward", "average"])
def test_linkage_is_its_definition(method):
    x = np.random.default_rng(2).normal(size=(50, 3))
    labels = C.agglomerate(x, 7, method)
    assert {frozenset(np.flatnonzero(labels == g)) for g in range(7)} == plain_linkage(x, 7, method)


def test_registered_linkages_and_comparison(spark, root):
    rows = spark.read.parquet(f"{root}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    got = {r.vec_id: r.label for r in QUERIES["cl_02_ward"](spark, root).collect()}
    assert [got[r.vec_id] for r in rows] == C.agglomerate(x, 10, "ward").tolist()
    found = {r.method: (r.n, r.ari) for r in QUERIES["cl_03_method_comparison"](spark, root).collect()}
    average = C.agglomerate(x, 10, "average")
    from ledgerline.operators.aggregates import adjusted_rand

    both = spark.createDataFrame([(int(r.label), int(a)) for r, a in zip(rows, average, strict=True)], "a int, b int")
    assert found["average"] == (len(rows), pytest.approx(adjusted_rand(both, "a", "b").first()[0]))
    assert len(found) == 4 and all(n > 0.9 * len(rows) and -0.2 < a < 1 for n, a in found.values())


def test_k_means_finds_separate_groups(spark, root):
    x = blobs()
    got = [r.label for r in C.k_means(points(spark, x), "id", "x", 3).orderBy("id").collect()]
    assert len(set(got[:30])) == len(set(got[30:60])) == len(set(got[60:])) == 1 and len(set(got)) == 3
    sizes = QUERIES["cl_01_k_means"](spark, root).groupBy("label").count().collect()
    assert len(sizes) == 10 and sum(r["count"] for r in sizes) == 500
    users = QUERIES["udf_06_user_clusters"](spark, root).collect()
    assert {r.label for r in users} == {0, 1, 2, 3} and len({r.territory_id for r in users}) == len(users)


def test_k_means_of_groups_is_lloyd_in_each(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 2))
    df = points(spark, x, g=[i % 3 for i in range(90)])
    got = {r.id: r.label for r in C.k_means_by(df, ["g"], "id", "x", 4).collect()}
    first = {r.g: r.i for r in df.groupBy("g").agg(F.min_by("id", F.struct(draw("g", "id", seed=3), "id")).alias("i")).collect()}
    for g in range(3):
        ids = np.arange(g, 90, 3)
        want = C.lloyd(x[ids], 4, int(np.flatnonzero(ids == first[g])[0]))
        assert [got[i] for i in ids] == want.tolist()


def test_k_means_of_few_rows(spark):
    df = points(spark, np.array([[1.0], [1.0], [5.0]]), g=[0, 0, 1])
    got = {r.id: r.label for r in C.k_means_by(df, ["g"], "id", "x", 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0}
    assert C.k_means_by(df.limit(0), ["g"], "id", "x", 3).count() == 0


def test_variable_k(spark, root):
    x = blobs(20, 4)
    got = {r.k: r for r in C.variable_k(points(spark, x), "id", "x").collect()}
    assert [k for k, r in got.items() if r.chosen] == [4]
    label = np.repeat(np.arange(4), 20)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(80):
        own = [j for j in range(80) if label[j] == label[i] and j != i]
        a, b = d[i, own].mean(), min(d[i, label == g].mean() for g in range(4) if g != label[i])
        s.append((b - a) / max(a, b))
    assert got[4].silhouette == pytest.approx(np.mean(s))
    rows = QUERIES["cl_07_variable_k"](spark, root).collect()
    assert [r.k for r in rows if r.chosen] == [max(rows, key=lambda r: (round(r.silhouette, 12), -r.k)).k] and len(rows) == 7


def test_s_dbw(spark):
    x = blobs(25, 3, 2)
    label = np.repeat(np.arange(3), 25)
    got = {r.convention: r for r in C.s_dbw(points(spark, x, l=label), "l", "x").collect()}
    groups = [x[label == g] for g in range(3)]
    norms = [np.linalg.norm(g.var(0)) for g in groups]
    reach = np.sqrt(sum(norms)) / 3
    near = lambda rows, c: int((np.linalg.norm(rows - c, axis=1) <= reach).sum())
    for name, r in got.items():
        ratios = []
        for i, j in combinations(range(3), 2):
            both = np.concatenate([groups[i], groups[j]])
            ci, cj = groups[i].mean(0), groups[j].mean(0)
            around = max(near(both, ci), near(both, cj)) if name == "pair" else max(near(groups[i], ci), near(groups[j], cj))
            ratios.append(near(both, (ci + cj) / 2) / around if around else None)
        assert r.scatter == pytest.approx(np.mean(norms) / np.linalg.norm(x.var(0)))
        assert r.status == "computed" and r.density == pytest.approx(np.mean(ratios)) and r.s_dbw == pytest.approx(r.scatter + r.density)
    alike = {r.status for r in C.s_dbw(points(spark, np.ones((6, 2)), l=[0, 0, 0, 1, 1, 1]), "l", "x").collect()}
    one = {r.status for r in C.s_dbw(points(spark, x, l=[0] * 75), "l", "x").collect()}
    assert alike == {"not defined: all rows alike"} and one == {"not defined: number of clusters"}


def modularity(w, label):
    same = label[:, None] == label[None, :]
    d = w.sum(1)
    return (w * same).sum() / w.sum() - ((d[:, None] * d[None, :]) * same).sum() / w.sum() ** 2


def test_communities(spark):
    rng = np.random.default_rng(4)
    n = 40
    w = np.zeros((n, n))
    for i, j in combinations(range(n), 2):
        if rng.random() < (0.7 if i // 10 == j // 10 else 0.04):
            w[i, j] = w[j, i] = rng.uniform(0.5, 1.5)
    edges = spark.createDataFrame([(i, j, float(w[i, j])) for i, j in combinations(range(n), 2) if w[i, j]], "u long, v long, weight double")
    got = {r.node: r.community for r in N.communities(edges).collect()}
    label = np.array([got[i] for i in range(n)])
    assert all(min(np.flatnonzero(label == g)) == g for g in set(label)) and len(set(label)) == 4
    assert modularity(w, label) >= modularity(w, np.arange(n) // 10) - 1e-9
    for i in range(n):  # no single move is better
        for g in set(label):
            moved = label.copy()
            moved[i] = g
            assert modularity(w, moved) <= modularity(w, label) + 1e-9


def test_communities_settle_however_many_rounds_they_need(spark):
    # a ring of many nodes with chords of like weights: labels travel for long
    rng = np.random.default_rng(6)
    n = 150
    pairs = {(i, (i + 1) % n) for i in range(n - 1)} | {tuple(sorted(map(int, rng.choice(n, 2, replace=False)))) for _ in range(3 * n)}
    weight = {p: float(v) for p, v in zip(sorted(pairs), rng.uniform(0.9, 1.1, len(pairs)), strict=True)}
    edges = spark.createDataFrame([(*p, v) for p, v in weight.items()], "u long, v long, weight double")
    got = {r.node: r.community for r in N.communities(edges).collect()}
    w = np.zeros((n, n))
    for (i, j), v in weight.items():
        w[i, j] = w[j, i] = v
    label = np.array([got[i] for i in range(n)])
    names, at = np.unique(label, return_inverse=True)
    one = np.eye(len(names))[at]
    d, total = w.sum(1), w.sum()
    to, size = w @ one, d @ one
    gain = to - d[:, None] * (size[None, :] - one * d[:, None]) / total
    assert (gain.max(1) - gain[np.arange(n), at]).max() <= 1e-9  # no single move is better
    inside = one.T @ w @ one
    joint = inside - np.outer(size, size) / total
    assert joint[~np.eye(len(names), dtype=bool)].max() <= 1e-9  # no two communities are better as one
    assert modularity(w, label) > 0.3


def test_registered_communities_settle(spark, root):
    from ledgerline.plans.clusters import graph

    edges = graph(spark, root).collect()
    got = {r.node: r.community for r in QUERIES["cl_04_communities"](spark, root).collect()}
    nodes = sorted(got)
    at = {v: i for i, v in enumerate(nodes)}
    w = np.zeros((len(nodes), len(nodes)))
    for e in edges:
        w[at[e.u], at[e.v]] = w[at[e.v], at[e.u]] = e.weight
    label = np.array([got[v] for v in nodes])
    assert modularity(w, label) > 0.3 and len(set(label)) < len(nodes) / 5
    joint = {r.id: r.cluster for r in QUERIES["cl_06_joint_affinity"](spark, root).collect()}
    assert set(joint) == set(nodes) and len(set(joint.values())) == 10


def test_consensus_cores_are_average_linkage(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = 12
    s = np.eye(n)
    for i, j in combinations(range(n), 2):
        if i // 6 == j // 6:  # two parts without a share between them
            s[i, j] = s[j, i] = rng.integers(0, 6) / 5
    pairs = spark.createDataFrame([(i, j, float(s[i, j])) for i, j in combinations(range(n), 2) if s[i, j]], "u long, v long, share double")
    nodes = spark.range(n + 1).select(F.col("id").alias("node"))
    got = {r.node: (r.core, r.score) for r in N.consensus_cores(pairs, nodes, 0.5).collect()}
    groups = [[i] for i in range(n)]
    while len(groups) > 1:
        i, j = max(combinations(range(len(groups)), 2), key=lambda p: (round(s[np.ix_(groups[p[0]], groups[p[1]])].mean(), 12), -groups[p[0]][0], -groups[p[1]][0]))
        if s[np.ix_(groups[i], groups[j])].mean() < 0.5 - 1e-12:
            break
        groups[i] = sorted(groups[i] + groups.pop(j))
    for g in groups:
        score = None if len(g) == 1 else pytest.approx((s[np.ix_(g, g)].sum() - len(g)) / (len(g) * (len(g) - 1)))
        assert all(got[i] == (g[0], score) for i in g)
    assert got[n] == (n, None)
    monkeypatch.setattr(N, "LARGEST", 3)
    with pytest.raises(Exception, match="are allowed"):
        N.consensus_cores(pairs, nodes, 0.5).collect()


def test_registered_cores(spark, root):
    rows = QUERIES["cl_20_consensus_cores"](spark, root).collect()
    share = {(r.u, r.v): r.share for r in QUERIES["cl_19_co_association"](spark, root).collect()}
    for core in {r.core for r in rows}:
        own = sorted(r.node for r in rows if r.core == core)
        score = next(r.score for r in rows if r.core == core)
        assert own[0] == core
        assert score is None if len(own) == 1 else score == pytest.approx(np.mean([share.get(p, 0.0) for p in combinations(own, 2)]))


def test_passports(spark):
    x = blobs(20, 2, 3)
    label, region = np.repeat([0, 1], 20), np.arange(40) % 4
    got = {r.l: r for r in N.passports(points(spark, x, l=label, region=region), "id", "l", "x", "region", draws=500).collect()}
    for g in (0, 1):
        own = x[label == g]
        r, d = got[g], np.linalg.norm(own - own.mean(0), axis=1)
        assert r.n == 20 and r.share == 0.5 and r.profile == pytest.approx(own.mean(0).tolist()) and r.radius == pytest.approx(d.mean())
        assert r.typical == [int(i) + 20 * g for i in np.argsort(d, kind="stable")[:5]] and r.regions == {str(k): 5 for k in range(4)}
        rng = np.random.default_rng(1)
        sums = np.array([own[region[label == g] == k].sum(0) for k in range(4)])
        means = [sums[p].sum(0) / 20 for p in rng.integers(0, 4, (500, 4))]
        low, high = np.quantile(means, [0.025, 0.975], axis=0)
        assert np.abs(np.array(r.low) - low).max() < 0.25 and np.abs(np.array(r.high) - high).max() < 0.25


def test_registered_passports_and_margins(spark, root):
    rows = QUERIES["cl_21_core_passports"](spark, root).collect()
    assert len(rows) == 10 and sum(r.n for r in rows) == 500 and sum(r.share for r in rows) == pytest.approx(1)
    for r in rows:
        assert sum(r.regions.values()) == r.n and len(r.typical) == 5 and all(a <= p <= b for a, p, b in zip(r.low, r.profile, r.high, strict=True))


def test_dealing_permutes_within_strata(spark):
    rows = [(i, i % 3, i * 10) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, s int, v int")
    got = N.dealt(df, "k", ["s"], "v", 4, 9).collect()
    assert len(got) == 240
    for d in range(1, 5):
        own = {r.k: r for r in got if r.draw == d}
        assert sorted(own) == list(range(60))
        for s in range(3):
            assert sorted(r.v for r in own.values() if r.s == s) == [v for _, q, v in rows if q == s]
        assert sum(own[k].v == v for k, _, v in rows) < 20
    counts = N.bootstrap_counts(df, "k", 3).groupBy("draw").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()
    assert [r.n for r in counts] == [60] * 3 and all(25 < r.kinds < 50 for r in counts)


def test_penalised_path(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4, 12, 2))
    df = spark.createDataFrame([(i, m, x[i, m].tolist()) for i in range(4) for m in range(12)], "tid long, m int, x array<double>")
    centres = np.array([[-0.5, 0.0], [0.5, 0.0], [0.0, 0.7]])
    got = {(r.tid, r.m): r.label for r in N.penalised(df, spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "label int, c array<double>"), "tid", "m", "x", 0.5).collect()}
    for i in range(4):
        last = None
        for m in range(12):
            cost = [((x[i, m] - c) ** 2).sum() + (0.5 if last is not None and j != last else 0.0) for j, c in enumerate(centres)]
            last = int(np.argmin(cost))
            assert got[(i, m)] == last


def test_months_are_all_clustered_and_aligned(spark, root):
    from ledgerline.plans.clusters import monthly

    x, _ = monthly(spark.newSession(), root.replace("0.001", "0.01"))
    sf = root.replace("0.001", "0.01")
    rows = {(r.tid, r.m): np.array(r.x) for r in x.collect()}
    labels = {(r.tid, r.m): r.label for r in QUERIES["cl_08_monthly_k_means"](spark, sf).collect()}
    assert labels.keys() == rows.keys() and len({m for _, m in rows}) > 70
    names = {(r.m, r.label): r.aligned for r in QUERIES["cl_09_alignment"](spark, sf).collect()}
    months = sorted({m for m, _ in names})
    centre = lambda m, l: np.mean([rows[t, q] for t, q in rows if q == m and labels[t, q] == l], axis=0)
    from itertools import permutations

    last = {}
    for m in months[:12]:
        own = sorted(l for q, l in names if q == m)
        assert len({names[m, l] for l in own}) == len(own)
        if last and len(own) <= len(last):
            cost = lambda to: sum(((centre(m, l) - last[j]) ** 2).sum() for l, j in zip(own, to, strict=True))
            assert cost([names[m, l] for l in own]) == pytest.approx(min(cost(p) for p in permutations(last, len(own))))
        last |= {names[m, l]: centre(m, l) for l in own}
    path = QUERIES["cl_10_switch_penalty"](spark, sf).collect()
    assert {(r.tid, r.m) for r in path} == rows.keys()


def test_overlaps_are_bhattacharyya(spark):
    rng = np.random.default_rng(3)
    x, label = blobs(15, 3, 2, 9) / 4, np.repeat(np.arange(3), 15)
    rows = {r.l: r for r in I.regions(points(spark, x, l=label, m=[0] * 45), "m", "l", "x").collect()}
    for g in range(3):
        own = x[label == g]
        assert rows[g].centre == pytest.approx(own.mean(0).tolist()) and rows[g].var == pytest.approx(((own - own.mean(0)) ** 2).sum() / own.size) and rows[g].n == 15
    a, b = rng.normal(size=(2, 3)), rng.normal(size=(4, 3))
    va, vb = rng.uniform(0.5, 2, 2), rng.uniform(0.5, 2, 4)
    o = I.overlap(a, va, b, vb)
    for i, j in ((0, 1), (1, 3)):
        v = (va[i] + vb[j]) / 2
        assert o[i, j] == pytest.approx(np.exp(-(((a[i] - b[j]) ** 2).sum() / (8 * v) + 1.5 * np.log(v / np.sqrt(va[i] * vb[j])))))


def test_identities_of_a_hand_made_story(spark):
    """Two clusters; one is away for two months and comes back, the other for good; a stranger, a look-alike and a double."""
    rows = []
    add = lambda m, l, x, n=5: rows.append((m, l, n, [float(x), 0.0], 1.0))
    for m in range(10):
        add(m, 0, 0.0)
        if m not in (2, 3):
            add(m, 1, 30.0)
        if m < 3:
            add(m, 2, 60.0)
    add(5, 3, 100.0)  # far from all: birth, then dormant, then gone
    add(6, 4, 2.4)  # a little like 0
    add(8, 5, 0.1)  # as like 0 as 0 itself
    df = spark.createDataFrame(rows, "m int, label int, n long, centre array<double>, var double")
    t = spark.createDataFrame([(0.6, 0.05, 0.3)], "keep double, margin double, floor double")
    got = {}
    for r in I.follow(df, "m", "label", t).collect():
        got.setdefault((r.m, r.label if r.label is not None else f"id{r.identity}"), []).append((r.status, r.identity))
    assert [got[0, k] for k in range(3)] == [[("initial", k)] for k in range(3)]
    assert got[1, 1] == [("continuing", 1)] and got[2, "id1"] == [("dormant", 1)] and got[4, 1] == [("reemergence", 1)]
    assert [got[m, "id2"] for m in (3, 4, 5, 6)] == [[("dormant", 2)]] * 3 + [[("disappearance", 2)]] and (7, "id2") not in got
    assert got[5, 3] == [("birth", 3)] and got[9, "id3"] == [("disappearance", 3)]
    assert got[6, 4] == [("birth_candidate", 4)]
    assert got[8, 0][0][0] == "continuing" and got[8, 5][0] == ("ambiguous", None)


def test_calibration_matches_a_plain_one(spark):
    x, label = blobs(12, 3, 2, 11) / 3, np.repeat(np.arange(3), 12)
    df = points(spark, x, l=label, m=[0] * 36)
    overlaps = I.resampled(df, "id", "m", "l", "x", draws=20)
    got = {(r.draw, r.l, r.other): r.overlap for r in overlaps.collect()}
    u = {(r.id, r.draw): 1 - r.u / 2**60 for r in spark.range(36).crossJoin(spark.range(20).select(F.col("id").cast("int").alias("draw"))).select("id", "draw", draw("id", F.lit(0), "draw", seed=31).alias("u")).collect()}
    full = {g: (x[label == g].mean(0), ((x[label == g] - x[label == g].mean(0)) ** 2).mean()) for g in range(3)}
    for d in range(20):
        for g in range(3):
            own = [i for i in np.flatnonzero(label == g) for _ in range(sum(u[i, d] <= t for t in I.TAILS))]
            c = x[own].mean(0)
            v = ((x[own] - c) ** 2).mean()
            for h, (ch, vh) in full.items():
                want = I.overlap(c[None], np.array([v]), ch[None], np.array([vh]))[0, 0]
                assert got[d, g, h] == pytest.approx(want, rel=1e-6)
    own = [v for (_, g, h), v in got.items() if g == h]
    other = [v for (_, g, h), v in got.items() if g != h]
    r = I.calibrate(overlaps, "l").first()
    assert (r.keep, r.floor, r.margin) == pytest.approx((np.quantile(other, 0.95), np.median(other), max(0.0, np.quantile(own, 0.05) - np.quantile(other, 0.95))))
    one = I.calibrate(I.resampled(df.withColumn("l", F.lit(0)), "id", "m", "l", "x", draws=3), "l").first()
    assert (one.keep, one.margin, one.floor) == (0.5, 0.0, 0.25)


def test_identity_worlds_are_scored(spark, root):
    got = {r.world: r.asDict() for r in QUERIES["cl_16_identity_worlds"](spark, root).collect()}
    assert set(got) == set(I.WORLDS)
    assert got["stationary"]["tp"] + got["stationary"]["fn"] == 46 and got["stationary"]["fp"] == 0
    for name, r in got.items():
        _, truth, expected = I.world(name)
        wanted = sum(k in ("birth", "disappearance") for _, k, _ in expected)
        assert r["event_tp"] + r["event_fn"] == wanted
    with_label_truth = spark.createDataFrame([("w", m, l, "AB"[l]) for m in range(6) for l in (0, 1) if not (l == 1 and m == 3)], "world string, m int, label int, subject string")
    events = [("w", 0, 0, 0, "initial"), ("w", 0, 1, 1, "initial"), ("w", 1, 0, 0, "continuing"), ("w", 1, 1, 1, "continuing"), ("w", 2, 0, 1, "continuing"), ("w", 2, 1, None, "ambiguous"), ("w", 3, 0, 0, "reemergence"), ("w", 4, 0, 0, "continuing"), ("w", 4, 1, 1, "reemergence"), ("w", 5, 0, 0, "continuing"), ("w", 5, 1, 7, "birth")]
    e = spark.createDataFrame(events, "world string, m int, label int, identity long, status string")
    r = I.score_identities(e, with_label_truth).first()
    assert (r.tp, r.fp, r.fn, r.event_tp, r.event_fp, r.event_fn) == (6, 1, 3, 0, 1, 0)


def test_thresholds_replay(spark, root):
    sf = root.replace("0.001", "0.01")
    rows = QUERIES["cl_38_threshold_sensitivity"](spark, sf).collect()
    assert all(r.n == r.as_stored for r in rows if r.factor == 1.0) and any(r.n != r.as_stored for r in rows if r.factor != 1.0)
    stored = QUERIES["cl_14_identity_tracking"](spark, sf).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in stored} == {r.status: r.n for r in rows if r.factor == 1.0}


def test_grouped_folds_match_a_plain_fit(spark, root):
    from ledgerline.functions.calendar import at_lag
    from ledgerline.operators import panel as P

    n = spark.read.parquet(f"{root}/nation.parquet").selectExpr("cast(n_nationkey as long) as tid", "n_regionkey as fold")
    t = P.totals(spark, root).withColumns({"a": at_lag("value", 1, ["tid"]), "b": at_lag("value", 12, ["tid"])}).na.drop().join(n, "tid").toPandas()
    for r in QUERIES["cl_32_grouped_folds"](spark, root).collect():
        train, test = t[t["fold"] != r.fold], t[t["fold"] == r.fold]
        x, y = train[["a", "b"]].to_numpy(float), train["value"].to_numpy(float)
        z = (x - x.mean(0)) / x.std(0)
        beta = np.linalg.solve(z.T @ z / len(z) + 0.1 * np.eye(2), z.T @ (y - y.mean()) / len(z)) / x.std(0)
        e = test["value"] - (y.mean() + (test[["a", "b"]].to_numpy(float) - x.mean(0)) @ beta)
        assert r.n == len(test) and r.mae == pytest.approx(np.abs(e).mean())


def test_weight_ablation(spark, root):
    rows = QUERIES["cl_35_weight_ablation"](spark, root).collect()
    assert len(rows) == 15 and {r.weight for r in rows} == {0.0, 0.5, 1.0} and {r.seed for r in rows} == set(range(5))
    assert all(-0.1 < r.ari < 0.1 for r in rows)  # the labels of the table are no clusters
