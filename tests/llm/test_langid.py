import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ledgerline.llm import langid as L

from .common import SCHEMA, awkward, documents


def test_held_out_accuracy(spark, root):
    from ledgerline.llm.registry import QUERIES

    sf = root.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op9_language_id"](spark, sf).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    apart = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in apart]) >= 0.98


def test_nothing_of_a_held_out_row_is_learned(spark):
    rows = [(i, ("der die und ist " if i % 2 else "the and of is ") * 5, "de" if i % 2 else "en", "s", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    odd = spark.createDataFrame([(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else g, s, n) for i, t, g, s, n in rows], SCHEMA)
    a, b = (sorted(L.identify_languages(d).collect()) for d in (docs, odd))
    assert a == b and {r.lang_pred for r in a} == {"de", "en"}


def test_awkward_rows(spark):
    docs = documents(spark, awkward())
    got = L.identify_languages(docs).collect()
    assert len(got) == len(awkward())
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (2, 3, 4)} == {("und", 0.0)}
    assert L.identify_languages(docs.limit(0)).collect() == []
    unlabelled = spark.createDataFrame([(1, "some words", None, "s", 1), (2, "123 !!", None, "s", 1)], SCHEMA)
    assert {r.lang_pred for r in L.identify_languages(unlabelled).collect()} == {"und"}


def test_slices_of_long_texts_count_alike(monkeypatch):
    for text in ("Straße und Häuser " * 500, "a1b " * 300 + "!" * 400, "?" * 300 + "ΟΔΟΣ, ok" * 99, "x" * 1000):
        whole = L.features(text)
        for size in (1, 7, 100, 333):
            monkeypatch.setattr(L, "SLICE", size)
            parts = L.features(text)
            assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
        monkeypatch.undo()
    assert L.features("123 ") is None and L.features(None) is None


def test_n_grams_are_those_of_the_padded_letters():
    text = "Ab1 cd! e"
    padded = " ab cd e "
    grams = [*padded[1:-1], *(padded[i : i + 2] for i in range(8)), *(padded[i : i + 3] for i in range(7))]
    some, weight = L.features(text)
    assert np.round(np.exp(weight - 1)).sum() == len(grams) and len(some) == len(set(grams))


def plain_ftrl(rows, classes, idf, epochs):
    """Multinomial regression by the published per-coordinate update, over dictionaries."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(j, c):
        v = z[j, c]
        return 0.0 if abs(v) <= L.L1 else (math.copysign(L.L1, v) - v) / ((L.BETA + math.sqrt(n[j, c])) / L.ALPHA + L.L2)

    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            y, at, tf = rows[i]
            x = [float(v) * idf[j] for j, v in zip(at, tf, strict=True)]
            size = math.sqrt(sum(v * v for v in x))
            x = [*(v / size for v in x), 1.0]
            at = [*at, L.DIMS]
            score = [sum(v * weight(j, c) for j, v in zip(at, x, strict=True)) for c in range(classes)]
            top = max(score)
            e = [math.exp(s - top) for s in score]
            p = [v / sum(e) for v in e]
            steps = [(j, c, v * (p[c] - (c == y)), weight(j, c)) for j, v in zip(at, x, strict=True) for c in range(classes)]
            for j, c, g, w in steps:
                after = n[j, c] + g * g
                z[j, c] += g - (math.sqrt(after) - math.sqrt(n[j, c])) / L.ALPHA * w
                n[j, c] = after
    return {k: weight(*k) for k in z}


def test_fit_matches_a_plain_one_and_temperature_is_best():
    rng = np.random.default_rng(2)
    idf = np.ones(L.DIMS) + rng.random(L.DIMS)
    names, rows = ["a", "b", "c"], []
    for _ in range(60):
        y = int(rng.integers(0, 3))
        at = np.unique(np.concatenate([rng.integers(0, 30, 5), rng.integers(100 + 10 * y, 108 + 10 * y, 2)]))
        rows.append((names[int(rng.integers(0, 3))] if rng.random() < 0.2 else names[y], at, 1 + rng.random(len(at))))
    model = L.fit(names, idf, rows)
    seen, train, apart = set(), [], []
    for i, r in enumerate(rows):
        (train if i % 5 or r[0] not in seen else apart).append(r)
        seen.add(r[0])
    want = plain_ftrl([(names.index(g), at.tolist(), tf.tolist()) for g, at, tf in train], 3, idf, L.EPOCHS)
    for (j, c), w in want.items():
        assert (model.weights[j, c] if j < L.DIMS else model.intercepts[c]) == pytest.approx(w, abs=1e-5)

    def calibration(t):
        out = 0.0
        for g, at, tf in apart:
            x = model.vector((at, tf)) @ model.weights[at] + model.intercepts
            out -= math.log(np.exp(x / t)[names.index(g)] / np.exp(x / t).sum())
        return out

    assert all(calibration(model.temperature) <= calibration(t) + 1e-6 for t in np.exp(np.linspace(-3, 3, 61)))


def test_repeated_documents_count_once(spark):
    rows = [(i, ("der die und ist " if i % 2 else "the and of is ") * (2 + i % 3), "de" if i % 2 else "en", "s", 1) for i in range(40)]
    once = L.train(spark.createDataFrame(rows, SCHEMA))
    again = L.train(spark.createDataFrame(rows + rows[:1] * 200, SCHEMA))
    assert once.names == again.names and (once.weights != 0).sum() > 0


def test_every_language_is_learned(spark):
    rows = []
    for k in range(300):
        word = "".join(chr(0x4E00 + 3 * k + j) for j in range(3))
        rows += [(10 * k + j, f"{word} " * (3 + j), f"l{k}", "s", 1) for j in range(4 if k < 290 else 2)]
    learned = {g for i, _, g, _, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    lang = {i: g for i, _, g, _, _ in rows}
    got = L.identify_languages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(learned) > 290 and all(r.lang_pred == lang[r.doc_id] for r in got if lang[r.doc_id] in learned)
