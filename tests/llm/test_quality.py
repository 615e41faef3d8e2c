import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import quality as Q

from .common import awkward, documents


def corpus(n=600, seed=1):
    rng = np.random.default_rng(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("la", "ne", "ri", "so", "tu", "mi")]
    texts, labels = [], []
    for i in range(n):
        words = list(rng.choice(vocabulary, rng.integers(30, 120)))
        kind = i % 5
        if kind == 0:
            words = [w + "%%%" for w in words]
        if kind == 1:
            for k in rng.integers(0, len(words), 3):
                words[k] = ("vilest", "worstly", "rotter")[k % 3]
        texts.append((i, " ".join(words)))
        labels.append((i, int(kind != 0), int(kind == 1)))
    return texts, labels


def test_held_out_selection(spark):
    texts, labels = corpus()
    rated = spark.createDataFrame([x for x in labels if x[0] < 400], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in Q.classify(documents(spark, texts), rated).collect()}
    held = [x for x in labels if x[0] >= 400]
    good = [i for i, q, t in held if q and not t]
    bad = [i for i, q, t in held if not q or t]
    assert np.mean([rows[i].kept for i in good]) >= 0.98
    assert np.mean([rows[i].kept for i in bad]) <= 0.05
    assert np.mean([rows[i].expected_grade for i in good]) > np.mean([rows[i].expected_grade for i in bad]) + 0.5


def test_thresholds_are_ordered_and_probabilities_sum():
    texts, labels = corpus(200)
    terms = [r for _, rows in Q._features_of(pa.array([t for _, t in texts])) for r in rows]
    model = Q.fit([(q + 1 - t, Q.spread(r)) for (_, q, t), r in zip(labels, terms, strict=True)])
    assert (np.diff(model.thresholds) > 0).all()
    p = model.grade_probabilities(np.linspace(-30, 30, 61))
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all() and (np.diff(p[:, -1]) >= 0).all()


def loss(score, grade, cut):
    upto = [0.0, *(1 / (1 + np.exp(-(c - score))) for c in cut), 1.0]
    return -np.log(upto[grade + 1] - upto[grade])


def test_gradients_by_differences():
    rng = np.random.default_rng(3)
    score, grade, cut = rng.normal(size=30) * 2, rng.integers(0, 3, 30), np.array([-0.7, 1.1])
    by_score, by_cut = Q.gradients(score, grade, cut)
    h = 1e-6
    for i in range(30):
        assert by_score[i] == pytest.approx((loss(score[i] + h, grade[i], cut) - loss(score[i] - h, grade[i], cut)) / (2 * h), abs=1e-6)
        for k in range(2):
            step = h * np.eye(2)[k]
            assert by_cut[i, k] == pytest.approx((loss(score[i], grade[i], cut + step) - loss(score[i], grade[i], cut - step)) / (2 * h), abs=1e-6)


def plain_fit(rows, epochs):
    """The fit of the docstrings again, number by number, over dictionaries."""
    n = len(rows)
    share = np.cumsum([sum(g == k for g, _ in rows) + 1 for k in range(2)]) / (n + 3)
    odds = [math.log(x / (1 - x)) for x in share]
    free, squares = [odds[0], math.log(max(odds[1] - odds[0], 1e-3))], [1e-8, 1e-8]
    z, sums = defaultdict(float), defaultdict(float)

    def weight(j):
        if abs(z[j]) <= Q.L1:
            return 0.0
        return (math.copysign(Q.L1, z[j]) - z[j]) / ((Q.BETA + math.sqrt(sums[j])) / Q.ALPHA + Q.L2)

    order = np.random.Generator(np.random.PCG64(11))
    for _ in range(epochs):
        turn = order.permutation(n)
        for i in range(n):
            cut = [free[0], free[0] + math.exp(free[1])]
            total, moved = defaultdict(float), [0.0, 0.0]
            for r in turn[i : i + 1]:
                g, at = rows[r]
                score = sum(weight(j) for j in at)
                f = [1 / (1 + math.exp(-(c - score))) for c in cut]
                low, high = (0.0 if g == 0 else f[g - 1]), (1.0 if g == 2 else f[g])
                own = [0.0, 0.0]
                if g < 2:
                    own[g] -= f[g] * (1 - f[g]) / (high - low)
                if g:
                    own[g - 1] += f[g - 1] * (1 - f[g - 1]) / (high - low)
                moved = [moved[0] + own[0], moved[1] + own[1]]
                for j in at:
                    total[j] -= sum(own)
            for j, d in total.items():
                w = weight(j)
                after = sums[j] + d * d
                z[j] += d - (math.sqrt(after) - math.sqrt(sums[j])) / Q.ALPHA * w
                sums[j] = after
            for k, d in enumerate([moved[0] + moved[1], moved[1] * math.exp(free[1])]):
                squares[k] += d * d
                free[k] -= Q.RATE * d / math.sqrt(1 + squares[k])
    return {j: weight(j) for j in z}, [free[0], free[0] + math.exp(free[1])]


def test_fit_matches_a_plain_one(monkeypatch):
    monkeypatch.setattr(Q, "L1", 1.5)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(50):
        grade = i % 3
        rows.append((grade, np.unique(np.concatenate([rng.integers(0, 40, 6), [100 + grade, 200 + i]]))))
    model = Q.fit(rows)
    weights, cut = plain_fit(rows, Q.EPOCHS)
    assert model.thresholds == pytest.approx(cut, abs=1e-9)
    for j, w in weights.items():
        assert model.weights[j] == pytest.approx(w, abs=1e-6)
    assert model.weights[100] < model.weights[101] < model.weights[102] and (model.weights != 0).sum() > 10
    # buckets of one row cannot pass L1 = 15 in 8 epochs, so that fit carries none of them
    monkeypatch.setattr(Q, "L1", 15.0)
    assert (Q.fit(rows).weights[200:250] == 0).all() and all(w == 0 for j, w in plain_fit(rows, Q.EPOCHS)[0].items() if j >= 200)


def test_repeated_documents_count_once(spark):
    texts, labels = corpus(120)
    rated = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    once = sorted(Q.classify(documents(spark, texts), rated).collect())
    model = Q.train(documents(spark, texts + texts[:50] * 4), rated)
    again = sorted(Q.rate(documents(spark, texts).select("doc_id", "text"), model).select("row.doc_id", "expected_grade", "tail_probability", "kept").collect())
    assert once == again


def test_held_out_ratings(spark, root):
    read = lambda t: spark.read.parquet(f"{root.replace('0.001', '0.1')}/{t}.parquet")
    _, rest = Q.held_out(read("documents"), read("labels"))
    rows = rest.collect()
    clean, other = [r for r in rows if r.grade == 2], [r for r in rows if r.grade < 2]
    assert len(clean) > 500 and len(other) > 100
    assert np.mean([r.kept for r in clean]) >= 0.99 and np.mean([r.kept for r in other]) <= 0.1


def test_awkward_rows_and_labels(spark):
    docs = documents(spark, awkward())
    schema = "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], schema)
    assert all(r.kept for r in Q.classify(docs, none).collect())
    odd = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, None, 1), (None, 1, 1), (99, 1, 0)], schema)
    assert Q.classify(docs, odd).count() == len(awkward())
    assert Q.drop_low_quality(docs, none).columns == docs.columns
    assert Q.classify(docs.limit(0), odd).collect() == []
