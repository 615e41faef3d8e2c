"""Forecasts, detectors and nulls against plain versions, and the rule that none of them sees later months."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.functions.calendar import at_lag
from ledgerline.functions.draws import draw
from ledgerline.operators import checks, detect, deviations, forecast, windows, worlds
from ledgerline.plans.catalog import QUERIES


def panel(spark, months=40, entities=3, seed=2, gap=None):
    rng = np.random.default_rng(seed)
    rows = [(t, "c", m, float(v)) for t in range(entities) for m, v in enumerate(rng.uniform(50, 90, months)) if (t, m) != gap]
    return spark.createDataFrame(rows, "tid long, cat string, m int, value double")


BY = ["tid", "cat"]


def lagged(df):
    return df.withColumns({"a": at_lag("value", 2, BY), "b": at_lag("value", 12, BY)}).na.drop()


PAST_ONLY = {
    "base": lambda df: forecast.base(df, BY, "cat", 2),
    "growth": lambda df: df.withColumn("p", forecast.growth(BY, 2, 3)),
    "history_mean": lambda df: df.withColumn("p", forecast.history_mean(BY, 2)),
    "balanced_ratio": lambda df: forecast.balanced_ratio(df, BY, "cat", 2),
    "smoothed": lambda df: forecast.smoothed(df, BY, "value"),
    "conditional_ses": lambda df: forecast.conditional_ses(df, BY, "cat", 2),
    "profile_ses": lambda df: forecast.profile_ses(df, BY, "cat", 2),
    "trend": lambda df: forecast.trend(df, BY, 2),
    "fit_ledger": lambda df: forecast.fit_ledger(df, BY, 2).drop("value", "m").withColumnRenamed("origin", "m"),
    "batched": lambda df: forecast.batched(df, BY, 2, lambda c, h, seed: [x.mean() for x in c]),
    "ridge_correction": lambda df: forecast.ridge_correction(lagged(df), ["a", "b"], "a", 20),
    "boosted": lambda df: forecast.boosted(lagged(df), ["a", "b"], 20, rounds=3),
    "page_hinkley": lambda df: detect.page_hinkley(df, BY, "m", "value"),
    "online_changepoint": lambda df: detect.online_changepoint(df, BY, "m", "value"),
    "threshold_alarms": lambda df: detect.threshold_alarms(df, df.filter("m < 20"), BY, "m", "value", 1.0),
    "online_top": lambda df: detect.online_top(df, "m", ["tid"], "value", 1, 2),
    "glr": lambda df: df.withColumn("p", windows.glr("value", BY)),
    "dormancy": lambda df: detect.dormancy(df.filter("value > 60 or m = 0"), ["tid"], "m", 0, 30),
}


@pytest.mark.parametrize("name", sorted(PAST_ONLY))
def test_later_months_change_nothing(spark, name):
    """Rows up to month 24 stay as they are when all values beyond change."""
    df = panel(spark)
    run = PAST_ONLY[name]
    assert checks.unchanged_before(lambda d: run(d).drop("_x"), df, "m", "value", 24, ["m"]).count() == 0
    assert run(df).filter("m <= 24").count() > 0


def test_smoothing_is_the_recursion(spark):
    df = panel(spark, gap=(1, 20))
    got = {(r.tid, r.m): (r.level, r.alpha) for r in forecast.smoothed(df, BY, "value").collect()}
    values = {}
    for r in df.collect():
        values.setdefault(r.tid, {})[r.m] = r.value
    want = {}
    for t, series in values.items():
        levels, losses = {}, {}
        for m in range(40):
            if m not in series:
                break
            for k in range(1, 20):
                a = k / 20
                if m == 0:
                    levels[a], losses[a] = series[0], 0.0
                else:
                    losses[a] += abs(series[m] - levels[a])
                    levels[a] = levels[a] + a * (series[m] - levels[a])
            if m >= 2:
                best = min(losses, key=lambda a: (losses[a], a))
                want[(t, m)] = (levels[best], best)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_hinges_fit_a_line_and_a_bend():
    t = np.arange(30)
    assert forecast.hinged(t, 5.0 + 2 * t, 35, 3, 10.0) == pytest.approx(75, rel=1e-3)
    bent = 10.0 + np.maximum(t - 12, 0) * 4
    assert forecast.hinged(t, bent, 32, 3, 0.001) == pytest.approx(10 + 20 * 4, rel=0.1)


def test_ledger_records_what_cannot_be_fitted(spark):
    rows = [(1, "c", m, 0.0 if m < 20 else 5.0) for m in range(24)] + [(2, "c", m, 1.0 + m) for m in range(10)]
    df = spark.createDataFrame(rows, "tid long, cat string, m int, value double")
    got = {(r.tid, r.origin): (r.status, r.reason, r.predicted) for r in forecast.fit_ledger(df, BY, 1).collect()}
    assert len(got) == 34 and got[(2, 9)][0] == "short history"
    assert got[(1, 15)][0] == "failed" and got[(1, 15)][1] and got[(1, 15)][2] is None
    assert got[(1, 23)][0] == "fitted" and got[(1, 23)][2] > 0


def test_weighted_ridge_is_augmented_least_squares(spark):
    rng = np.random.default_rng(4)
    x, w = rng.normal(size=(40, 2)) + [0, 5], rng.uniform(0.2, 3, 40)
    y = x @ [1.0, -2.0] + rng.normal(size=40)
    df = spark.createDataFrame([(*map(float, r), float(v), float(q)) for r, v, q in zip(x, y, w, strict=True)], "a double, b double, y double, w double")
    got = forecast.ridge(df, ["a", "b"], "y", 0.2, "w")
    mean = (w[:, None] * x).sum(0) / w.sum()
    spread = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / w.sum())
    z, my = (x - mean) / spread, (w * y).sum() / w.sum()
    design = np.vstack([np.sqrt(w / w.sum())[:, None] * z, np.sqrt(0.2) * np.eye(2)])
    beta = np.linalg.lstsq(design, np.concatenate([np.sqrt(w / w.sum()) * (y - my), np.zeros(2)]), rcond=None)[0] / spread
    assert got == pytest.approx(np.concatenate([[my - mean @ beta], beta]))


def test_ridge_correction_is_bounded_and_fitted_on_the_past(spark):
    df = lagged(panel(spark))
    got = forecast.ridge_correction(df, ["a", "b"], "a", 25).toPandas()
    past = df.filter("m <= 25").withColumn("_y", F.ln(F.col("value") / F.col("a")))
    beta = forecast.ridge(past, ["a", "b"], "_y", 1.0)
    want = got["a"] * np.exp(np.clip(beta[0] + beta[1] * got["a"] + beta[2] * got["b"], -0.1, 0.1))
    assert got["m"].min() > 25 and np.allclose(got["corrected"], want)


def test_boosted_trees_learn_a_step(spark):
    rows = [(i, float(i % 7), float(100 if i % 7 > 3 else 10)) for i in range(140)]
    df = spark.createDataFrame(rows, "m int, x double, value double")
    got = forecast.boosted(df, ["x"], 99).toPandas()
    assert got["m"].min() == 100 and np.abs(got["predicted"] - got["value"]).max() < 5


def test_block_bootstrap(spark):
    rows = [(m, float(m % 5 + 1), 1.0) for m in range(20) for _ in range(m % 3 + 1)]
    df = spark.createDataFrame(rows, "m int, a double, b double")
    r = forecast.block_bootstrap(df, "m", "a", "b", draws=4000).first()
    d = np.array([a - b for _, a, b in rows])
    s = np.array([sum(a - b for k, a, b in rows if k == m) for m in range(20)])
    n = np.array([sum(k == m for k, _, _ in rows) for m in range(20)])
    left = (s.sum() - s) / (n.sum() - n)
    assert r.difference == pytest.approx(d.mean()) and (r.jackknife_low, r.jackknife_high) == pytest.approx((left.min(), left.max()))
    assert r.blocks == 20 and r.zero_share == pytest.approx(np.mean([a == b for _, a, b in rows])) and r.largest_share == pytest.approx(3 / n.sum())
    rng = np.random.default_rng(0)
    means = [s[i].sum() / n[i].sum() for i in rng.integers(0, 20, (4000, 20))]
    assert (r.low, r.high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=0.08)


def run_lengths(x, hazard, longest, threshold):
    """The recursion again, number by number."""
    out, state = [], None
    for i, q in enumerate(x):
        scale = max(float(np.median(np.abs(np.diff(x[: i + 1])))), 1e-6) if i else 1.0
        if state is None:
            state, seen = [(1.0, q, 1.0, 1.0, scale**2)], 0
        new, born = [], 0.0
        for p, m, k, a, b in state:
            s2 = b * (k + 1) / (a * k)
            t = math.exp(math.lgamma(a + 0.5) - math.lgamma(a) - (a + 0.5) * math.log1p((q - m) ** 2 / (2 * a * s2)) - 0.5 * math.log(2 * math.pi * a * s2))
            born += p * t * hazard
            new.append((p * t * (1 - hazard), (k * m + q) / (k + 1), k + 1, a + 0.5, b + k * (q - m) ** 2 / (2 * (k + 1))))
        state = [(born, q, 1.0, 1.0, scale**2), *new][:longest]
        total = sum(s[0] for s in state)
        state = [(s[0] / total, *s[1:]) for s in state]
        seen += 1
        recent = state[0][0] + (state[1][0] if len(state) > 1 else 0.0) if seen >= 4 else 0.0
        out.append((recent, recent > threshold))
        if recent > threshold:
            state = None
    return out


def test_online_changepoint_is_the_recursion(spark):
    rng = np.random.default_rng(8)
    y = np.exp(np.concatenate([rng.normal(4, 0.1, 30), rng.normal(6, 0.1, 20)]))
    df = spark.createDataFrame([(1, m, float(v)) for m, v in enumerate(y)], "k int, m int, value double")
    got = [(r.p_recent, r.alarm) for r in detect.online_changepoint(df, ["k"], "m", "value").orderBy("m").collect()]
    want = run_lengths(np.log(y), 1 / 50, 24, 0.5)
    assert [a for _, a in got] == [a for _, a in want] and [p for p, _ in got] == pytest.approx([p for p, _ in want])
    assert any(a for _, a in got[30:34]) and not any(a for _, a in got[10:30])


def test_online_top_is_greedy(spark):
    rng = np.random.default_rng(5)
    rows = [(m, k, float(v)) for m in range(20) for k, v in enumerate(rng.integers(0, 30, 12))]
    got = {}
    for r in detect.online_top(spark.createDataFrame(rows, "m int, k int, v double"), "m", ["k"], "v", 3, 2).collect():
        got.setdefault(r.m, set()).add(r.k)
    last, want = {}, {}
    for m in range(20):
        free = sorted((-v, k) for mm, k, v in rows if mm == m and m - last.get(k, -99) > 2)[:3]
        want[m] = {k for _, k in free}
        last |= dict.fromkeys(want[m], m)
    assert got == want


def test_scoring_of_greedy_matches(spark):
    alarms = spark.createDataFrame([("a", 3), ("a", 4), ("a", 11), ("b", 7)], "k string, m int")
    onsets = spark.createDataFrame([("a", 4), ("a", 5), ("a", 10), ("b", 2)], "k string, onset int")
    matched = detect.greedy_match(alarms, onsets, ["k"], 2)
    assert sorted((r.k, r.onset, r.m) for r in matched.collect()) == [("a", 4, 4), ("a", 5, 3), ("a", 10, 11)]
    r = detect.score(matched, onsets, alarms).first()
    assert (r.events, r.alarms, r.hits, r.recall, r.precision, r.false_alarms) == (4, 4, 3, 0.75, 0.75, 1)
    assert (r.mean_delay, r.mean_abs_delay, r.early_share) == pytest.approx((-1 / 3, 1, 1 / 3))


def test_worlds_and_joint_bank(spark):
    w = worlds.worlds(spark, 300, 24, 5)
    again = worlds.worlds(spark, 300, 24, 5).repartition(3)
    x = np.array([r.x for r in w.orderBy("world", "m").collect()]).reshape(300, 24, 5)
    assert (x == np.array([r.x for r in again.orderBy("world", "m").collect()]).reshape(300, 24, 5)).all()
    late = x[:, 12:].reshape(-1, 5)
    assert np.abs(late.mean(0)).max() < 0.08 and np.abs(late.std(0) - 1).max() < 0.08
    assert np.mean(x[:, 12:-1] * x[:, 13:]) == pytest.approx(0.4, abs=0.05)
    r = worlds.joint_bank(w, 0.03).first()
    flat = x.reshape(-1, 5)
    scores = {"stouffer": np.abs(flat.sum(1)) / np.sqrt(5), "energy": (flat**2).sum(1), "max_abs": np.abs(flat).max(1)}
    q = {k: np.quantile(v, 0.97) for k, v in scores.items()}
    joint = np.max([scores[k] / q[k] for k in q], axis=0)
    assert [r[f"q_{k}"] for k in q] == pytest.approx(list(q.values())) and r.joint == pytest.approx(np.quantile(joint, 0.97))
    assert np.mean(joint > r.joint) <= 0.03 < np.mean(joint > 1)


def test_shrunk_precision_is_ledoit_wolf(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    got = worlds.shrunk_precision(df, ["a", "b", "c", "d"]).collect()
    z = x - x.mean(0)
    s = z.T @ z / 80
    mu = np.trace(s) / 4
    d2 = ((s - mu * np.eye(4)) ** 2).sum() / 4
    b2 = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / 80**2 / 4, d2)
    cov = b2 / d2 * mu * np.eye(4) + (1 - b2 / d2) * s
    corr = cov / np.sqrt(np.outer(np.diag(cov), np.diag(cov)))
    inverse = np.linalg.inv(corr)
    assert got[0].shrinkage == pytest.approx(b2 / d2)
    for r in got:
        i, j = "abcd".index(r.i), "abcd".index(r.j)
        assert (r.correlation, r.precision) == pytest.approx((corr[i, j], inverse[i, j]))


def test_conditional_null_matches_a_plain_one(spark):
    rng = np.random.default_rng(12)
    n, cats, months = 9, 3, 24
    level = rng.normal(0, 0.5, (n, cats, 1)) + np.cumsum(rng.normal(0, 0.08, (n, cats, months)), axis=2) - 1
    share = 1 / (1 + np.exp(-level))
    rows = [(e, c, m, float(share[e, c, m])) for e in range(n) for c in range(cats) for m in range(months) if (e, c, m) != (8, 0, 3)]
    peers = [(e, p, k + 1) for e in range(n) for k, p in enumerate(sorted((q for q in range(n) if q != e), key=lambda q: (abs(q - e), q))[:6])]
    df = spark.createDataFrame(rows, "e int, c int, m int, share double")
    pr = spark.createDataFrame(peers, "e int, peer int, rank int")
    got = {r.draw: r.n for r in deviations.conditional_null(df, pr, "e", "c", "m", 0, 6, draws=6, gap=0.002, score=0.5).collect()}
    s = share[:8]
    before, after = s[:, :, :12], s[:, :, 12:]
    base = before + np.median(after - before, axis=0)
    ok = ((base > 0) & (base < 1)).all(axis=(1, 2))
    before, after, base = before[ok], after[ok], base[ok]
    names = np.flatnonzero(ok)
    logit = lambda v: np.log(v / (1 - v))
    # the medians are those of all complete entities
    u = logit(before) - np.median(logit(s[:, :, :12]), axis=0)
    steps = np.diff(u, axis=2)
    steps -= steps.mean(axis=2, keepdims=True)

    def count(change):
        kept = 0
        for c in range(cats):
            flags, gaps = np.zeros((len(names), 12), bool), np.zeros((len(names), 12))
            for i, e in enumerate(names):
                near = [int(np.flatnonzero(names == p)[0]) for q, p, k in peers if q == e and k <= 6 and p in names]
                for m in range(12):
                    if len(near) < 5:
                        continue
                    v = change[near, c, m]
                    med = np.median(v)
                    gap = change[i, c, m] - med
                    common = change[i, c, m] - np.median(np.delete(change[:, c, m], i))
                    gaps[i, m] = gap
                    flags[i, m] = abs(gap) >= 0.002 and abs(gap / max(1.4826 * np.median(np.abs(v - med)), 0.0025)) >= 0.5 and gap * common > 0
                kept += any(flags[i, m : m + 3].all() and len(set(np.sign(gaps[i, m : m + 3]))) == 1 for m in range(10))
        return kept

    starts = spark.range(6).select(*(F.pmod(draw(F.col("id"), F.lit(b), seed=23), F.lit(11)).alias(f"s{b}") for b in range(4))).orderBy("id").collect()
    want = {-2: count(after - before), -1: count(base - before)}
    for d in range(6):
        times = [(starts[d][j // 3] + j % 3) % 11 for j in range(12)]
        noise = np.cumsum(steps[:, :, times], axis=2)
        want[d] = count(1 / (1 + np.exp(-(logit(base) + noise))) - before)
    assert got == want and want[-1] == 0 and max(want.values()) > 0


def test_registered_intervals_and_bank(spark, root):
    """Queries whose draws SQL can't repeat: their values hang together."""
    for name in ("fc_23_block_bootstrap", "fc_31_paired_intervals"):
        r = QUERIES[name](spark, root).first()
        assert r.low <= r.difference <= r.high and r.jackknife_low <= r.difference <= r.jackknife_high
    r = QUERIES["det_17_conditional_null"](spark, root).first()
    assert r.without_noise == 0 and r.low <= r.median <= r.high
    r = QUERIES["det_12_joint_bank"](spark, root).first()
    assert r.joint > 1
    assert QUERIES["det_11_worlds"](spark, root).count() == 200 * 24
    p = QUERIES["det_10_shrunk_covariance"](spark, root).collect()
    assert len(p) in (0, 25) and all(r.correlation == pytest.approx(1) for r in p if r.i == r.j)


@pytest.mark.parametrize("name", ["fc_17_ridge_correction", "fc_18_weighted_ridge", "fc_19_boosted_trees"])
def test_fitted_forecasts_follow_the_split(spark, root, name):
    rows = QUERIES[name](spark, root).toPandas()
    column = "corrected" if "corrected" in rows else "predicted"
    assert len(rows) > 0 and rows["m"].min() > 23980 and (rows[column] > 0).all()
    if "yo" in rows:
        assert (np.abs(np.log(rows["corrected"] / rows["yo"])) <= 0.1 + 1e-9).all()


@pytest.mark.parametrize("name", ["fc_20_hinged_trend", "fc_29_conditional_trend"])
def test_trends_match_a_fit_of_their_own(spark, root, name):
    from ledgerline.operators import panel as P

    t = P.totals(spark, root).toPandas()
    med = t.groupby("m")["value"].median()
    got = {(r.tid, r.m): r.predicted for r in QUERIES[name](spark, root).collect()}
    tid = next(iter(got))[0]
    own = t[t["tid"] == tid].sort_values("m")
    for m in [m for k, m in got if k == tid][:5]:
        past = own[own["m"] <= m - 3]
        x, y = past["m"].to_numpy(), past["value"].to_numpy() / (med[past["m"]].to_numpy() if "conditional" in name else 1.0)
        u = (x - x[0]) / max(x[-1] - x[0], 1)
        knots = [0.2, 0.4, 0.6]
        z = np.array([[1.0, v, *(max(v - k, 0) for k in knots)] for v in u])
        beta = np.linalg.solve(z.T @ z + np.diag([1e-9, 1e-9, 0.1, 0.1, 0.1]), z.T @ (y / y.mean()))
        v = (m - x[0]) / max(x[-1] - x[0], 1) if "conditional" in name else (m - x[0]) / max(x[-1] - x[0], 1)
        want = max(np.array([1.0, v, *(max(v - k, 0) for k in knots)]) @ beta * y.mean(), 0.0)
        assert got[(tid, m)] == pytest.approx(want * (med[m - 3] if "conditional" in name else 1.0), rel=1e-6)


def test_batches_of_a_pretrained_model(spark):
    df = panel(spark, entities=2)
    got = forecast.batched(df, BY, 3, lambda contexts, h, seed: [len(c) + seed % 1000 / 1e4 for c in contexts], least=10, longest=15, batch=8).toPandas()
    again = forecast.batched(df.repartition(3), BY, 3, lambda contexts, h, seed: [len(c) + seed % 1000 / 1e4 for c in contexts], least=10, longest=15, batch=8).toPandas()
    order = ["tid", "m"]
    assert got.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))
    one = got[got["tid"] == 0].sort_values("m")
    assert one["m"].tolist() == list(range(12, 40)) and (one["origin"] == one["m"] - 3).all()
    assert np.floor(one["predicted"]).tolist() == [min(m - 2, 15) for m in one["m"]]
    assert one["predicted"].mod(1).round(6).nunique() == 4  # a seed for each batch


def test_constraints_and_ingest(spark):
    stored = spark.createDataFrame([(1, 10), (2, 20)], "k int, f int")
    parent = spark.createDataFrame([(10,), (20,), (30,)], "p int")
    more = lambda *rows: spark.createDataFrame(list(rows), "k int, f int")
    assert sorted(map(tuple, checks.ingest(stored, more((3, 30), (4, None)), ["k"], parent, "f", "p").collect())) == [(1, 10), (2, 20), (3, 30), (4, None)]
    for wrong, why in ((more((2, 10)), "key repeats"), (more((5, 99)), "refers to nothing")):
        with pytest.raises(Exception, match=why):
            checks.ingest(stored, wrong, ["k"], parent, "f", "p").collect()
