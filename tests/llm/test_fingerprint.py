import hashlib
import random
from collections import Counter

import numpy as np

from ledgerline.llm import fingerprint as Fp

from .common import awkward, documents


def test_collision_rate_is_generalised_jaccard():
    rng, errors = random.Random(3), []
    for k in range(150):
        words = [f"{k}w{i}" for i in range(12)]
        a = [rng.choice(words) for _ in range(rng.randint(30, 120))] if k % 2 else [rng.choice(words[:2])] * 20 + [rng.choice(words) for _ in range(30)]
        b = [w if rng.random() > 0.15 else rng.choice(words) for w in a]
        x, y = (Counter(tuple((["^"] * 4 + t)[i : i + 5]) for i in range(len(t))) for t in (a, b))
        true = sum((x & y).values()) / sum((x | y).values())
        p, q = Fp.fingerprints([" ".join(a), " ".join(b)])
        errors.append(Fp.likeness(p, q) - true)
    e = np.array(errors)
    assert abs(e.mean()) < 0.02 and np.sqrt((e**2).mean()) < 0.08


def test_equal_texts_and_blocks():
    long = " ".join(f"w{i % 400}" for i in range(Fp.BLOCK + 500))
    texts = ["", " \n", "a", "a b", long, long + " z", "a"]
    alone = [Fp.fingerprints([t])[0] for t in texts]
    assert Fp.fingerprints(texts) == alone
    assert alone[0] == alone[1] and alone[2] == alone[6] and alone[2] != alone[3]
    assert Fp.likeness(alone[4], alone[5]) > 0.9 and Fp.likeness(alone[0], alone[2]) < 0.1


def test_query_against_brute_force(spark, root):
    from ledgerline.llm.registry import QUERIES

    got = {r.doc_id: r for r in QUERIES["op3_cws_fingerprints"](spark, root).collect()}
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    texts = [d.text or "" for d in docs]
    after = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, after, strict=True)]
    own, changed = Fp.fingerprints(texts), Fp.fingerprints(edited)
    for i, d in enumerate(docs):
        r = got[d.doc_id]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(texts[i]), hashlib.sha256(edited[i].encode()).hexdigest(), own[i], changed[i])
        assert (r.near_edited, r.near_next) == (Fp.likeness(own[i], changed[i]), Fp.likeness(own[i], own[(i + 1) % len(docs)]))


def test_awkward_rows(spark):
    docs = documents(spark, awkward())
    rows = Fp.fingerprint_documents(docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in awkward())
    assert Fp.fingerprint_documents(docs.limit(0)).collect() == []
    one = Fp.fingerprint_documents(documents(spark, [(7, "only this one here now")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
