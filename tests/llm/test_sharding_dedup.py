import re
import zlib

import numpy as np
import pytest

from ledgerline.llm import exact_dedup as X
from ledgerline.llm import sharding as S
from ledgerline.llm.registry import QUERIES, SQL
from tests import oracle

from .common import awkward, documents


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 65_537])
def test_permutation_is_one_and_inverts(n):
    x = np.arange(n)
    p = S.Permutation(n, seed=n)
    y = p.apply(x)
    assert sorted(y) == list(x) and (p.invert(y) == x).all()
    assert n < 1000 or not (y == np.sort(y)).all()


def test_shards_by_rows(spark, root):
    rows = QUERIES["op1_feistel_shards"](spark, root).collect()
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    n = len(docs)
    assert len(rows) == n and {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    by_id = {r.doc_id: r for r in rows}
    shard, slot = S.place(np.arange(n), n)
    for i, d in enumerate(docs):
        r, raw = by_id[d.doc_id], (d.text or "").encode()
        assert (r.size, r.text_crc32, r.shard, r.slot) == (len(raw) + 8, zlib.crc32(raw), shard[i], slot[i])
    assert (S.row_at(shard, slot, n) == np.arange(n)).all()


def test_shards_of_awkward_rows(spark):
    rows = S.shard(documents(spark, awkward()), shards=4).collect()
    assert len(rows) == len(awkward())
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (3, 4)
    assert S.shard(documents(spark, awkward()).limit(0)).collect() == []


def test_exact_dedup_matches_sql(spark, root):
    oracle.same(oracle.connect(root), QUERIES["op2_exact_dedup"](spark, root), SQL["op2_exact_dedup"])


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_dedup_of_awkward_rows(spark, digest_all):
    rows = X.exact_dedup(documents(spark, awkward()), digest_all).collect()
    groups = {}
    for i, t in awkward():
        groups.setdefault(normal(t), []).append(i)
    want = sorted(((i is None, i or 0), min((x for x in ids if x is not None), default=None), len(ids)) for ids in groups.values() for i in ids)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.keep_id, r.group_size) for r in rows) == want
    assert sum(r.kept for r in rows) == len(groups)
    assert X.exact_dedup(documents(spark, awkward()).limit(0), digest_all).collect() == []


def test_drop_keeps_one_of_each_and_all_columns(spark):
    docs = documents(spark, awkward())
    kept = X.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(normal(r.text) for r in kept.collect()) == sorted({normal(t) for _, t in awkward()})
    assert X.drop_exact_copies(docs.limit(0)).collect() == []


def test_same_length_and_prefix_but_other_end(spark):
    head = "p" * 400
    rows = X.exact_dedup(documents(spark, [(1, head + "a"), (2, head + "b"), (3, head + "a")])).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in rows} == {(1, 1, True), (2, 2, True), (3, 1, False)}
