import random

import pyarrow as pa
import pytest

from ledgerline.llm import ngram_join as N

from .common import awkward, brute_components, documents, shingles


def near_copies(seed, groups=6, members=14, words=90, edits=4):
    """Groups of near copies around one text each, chains, copies, a passage shared by many, and loners."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(25)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(members):
            t = list(base)
            for _ in range(rng.randint(0, edits)):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
        chain = list(base)
        for _ in range(6):
            chain[rng.randrange(len(chain))] = word()
            texts.append(" ".join(chain))
    for _ in range(25):
        texts.append(" ".join([word() for _ in range(rng.randint(0, 30))] + passage + [word() for _ in range(rng.randint(0, 30))]))
    texts += texts[:10] + [t.upper() for t in texts[:3]] + ["one two", "One  Two", "one two three", "", " "]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed, pivots", [(1, 8), (2, 1)])
def test_components_match_brute_force(spark, monkeypatch, seed, pivots):
    monkeypatch.setattr(N, "PIVOTS", pivots)  # one pivot leaves much to the last, exhaustive step
    rows = near_copies(seed)
    got = {tuple(r) for r in N.ngram_join(documents(spark, rows))[0].collect()}
    assert got == brute_components(rows)


def test_query_matches_brute_force(spark, root):
    from ledgerline.llm.registry import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in QUERIES["op10_ngram_jaccard_join"](spark, root).collect()} == brute_components(docs)


def test_every_link_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BUCKET_PART", 5)
    rows = near_copies(3, groups=3)
    members, links = N.ngram_join(documents(spark, rows), every=True)
    sets = {i: shingles(t) for i, t in rows}
    linked = {(i, j) for i, s in sets.items() for j, t in sets.items() if i < j and s and t and 100 * len(s & t) >= 80 * len(s | t)}
    assert {r.doc_id: r.n_links for r in members.collect()} == {i: sum(i in p for p in linked) for i in sets}
    assert {tuple(r[:3]) for r in members.collect()} == brute_components(rows)
    between = {frozenset((sets[i], sets[j])) for i, j in linked if sets[i] != sets[j]}
    assert links.count() == len(between)
    assert sorted(links.toPandas()["overlap"]) == sorted(len(frozenset.intersection(*p)) for p in between)


def test_what_is_dealt_does_not_grow_with_the_fragments():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(5000)]
    texts = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    sent = {}
    for fragments in (48, 3000):
        out = list(N._deal(fragments)(iter([batch])))
        sent[fragments] = sum(c.nbytes for b in out for c in b.columns) / sum(map(len, texts))
        assert sum(len(x) for b in out for x in b.column(1).to_pylist() if x) // 4 > 2000 * 120
    assert sent[3000] < 1.1 * sent[48] and sent[3000] < 1.5


def test_small_sets_and_halves_miss_no_partner(spark):
    """Sets around the size up to which they are counted whole, each with a partner at the threshold."""
    rng = random.Random(9)
    rows = []
    for n in [*range(1, 60), 120, 200]:
        words = [f"w{rng.random()}" for _ in range(n + 4)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[: len(words) - n // 5]))]
    assert {tuple(r) for r in N.ngram_join(documents(spark, rows))[0].collect()} == brute_components(rows)


def test_pairs_of_a_hub_are_dealt_to_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "PAIRS_IN_BLOCK", 1000)
    hub = spark.range(1, 20_001).selectExpr("0L as a", "id as b", "300L as n_a", "300L as n_b")
    other = spark.range(1, 5_001).selectExpr("id as a", "id + 1 as b", "300L as n_a", "300L as n_b")
    cut, blocks = N._blocked(hub.unionByName(other))
    sizes = sorted(r["count"] for r in cut.groupBy("block").count().collect())
    assert blocks == 26 and sum(sizes) == 25_000 and sizes[-1] <= 2.5 * sizes[len(sizes) // 2]


def test_one_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "PAIRS_IN_BLOCK", 2000)
    monkeypatch.setattr(N, "PROBES", 5000)
    rng = random.Random(6)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(3000):
        t = list(base)
        t[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(t)))
    got = N.ngram_join(documents(spark, rows))[0].collect()
    assert len(got) == 3000 and {r.component_id for r in got} == {0}


def test_a_pair_at_the_threshold(spark):
    words = [f"w{i}" for i in range(104)]  # 100 shingles
    other = words[:93] + [f"v{i}" for i in range(11)]  # 89 of them and 11 of its own: 89 / 111 = 0.8018
    less = words[:92] + [f"u{i}" for i in range(12)]  # 88 / 112 = 0.7857
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(less))]
    got = {tuple(r) for r in N.ngram_join(documents(spark, rows))[0].collect()}
    assert got == brute_components(rows) and (2, 100, 1) in got and (3, 100, 3) in got


def test_awkward_rows(spark):
    rows = awkward()
    got = N.ngram_join(documents(spark, rows))[0].collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert by[1] == by[7] == by[10] == {(2, 1)} and by[None] == {(2, 1), (0, None)}
    assert by[2] == {(0, 2)} and by[5] == {(59_996, 5)} and by[6] == {(59_997, 5)}
    kept = N.drop_near_copies(documents(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 8, 9, None}
    assert N.ngram_join(documents(spark, rows).limit(0))[0].collect() == []
