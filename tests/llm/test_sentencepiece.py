import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from ledgerline.llm import sentencepiece_bpe as B

from .common import awkward, documents


@pytest.fixture(scope="module")
def both():
    model = B.default_model()
    return B.pieces_of(model), sentencepiece.SentencePieceProcessor(model_proto=model)


def odd_texts():
    rng = random.Random(5)
    out = ["", " ", "  ", "   a", "a ", " a  b   c    d", "x" * 700, " " * 1000 + "y", "a\nb\tc\r\n", "▁▁ foo▁bar", "梦 日本語テスト 😀😀 \u0000x", "<s> </s> <unk> <0x41>", "aaaa aaaaaaa abababababa the the theethethe", "​﻿ fi ﬁ"]
    alphabet = "ab  ▁thein\n.é梦😀"
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    return out + [" " * k + "x" + " " * (3 * k) for k in range(40)]


def test_ids_and_text_equal_the_library(both, spark, root):
    pieces, library = both
    texts = odd_texts() + [r.text for r in spark.read.parquet(f"{root}/documents.parquet").select("text").collect()]
    got, want = B.encode(pieces, texts), library.encode(texts, add_bos=True, add_eos=True)
    assert [list(g) for g in got] == want
    assert [B.decode(pieces, g.astype(np.int64)) for g in got] == [library.decode(w) for w in want]


def test_decoding_any_ids(both):
    pieces, library = both
    rng = random.Random(9)
    for _ in range(1500):
        ids = [rng.randrange(0, 32000) if rng.random() < 0.5 else rng.randrange(0, 259) for _ in range(rng.randint(0, 12))]
        assert B.decode(pieces, np.array(ids, np.int64)) == library.decode(ids)


def test_texts_in_parts_are_the_same(both):
    pieces, _ = both
    texts = [t for t in odd_texts() if t][:200]
    parts = [[] for _ in texts]
    for i, ids, _, _ in B.encode_texts(pieces, texts, limit=40):
        parts[i].append(ids)
    assert [list(np.concatenate(p)) for p in parts] == [list(x) for x in B.encode(pieces, texts)]


def test_heap_and_rounds_agree(both, monkeypatch):
    pieces, _ = both
    texts = [t for t in odd_texts() if t][:300]
    rounds = B.encode(pieces, texts)
    monkeypatch.setattr(B, "LONG", 0)
    assert [list(x) for x in B.encode(pieces, texts)] == [list(x) for x in rounds]


def test_query_and_round_trip(both, spark, root):
    from ledgerline.llm.registry import QUERIES

    _, library = both
    docs = spark.read.parquet(f"{root}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in QUERIES["op7_sentencepiece"](spark, root).collect():
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    back = B.decode_documents(B.encode_documents(docs)).collect()
    assert {r.doc_id: r.text for r in back} == texts


def test_awkward_rows(spark):
    docs = documents(spark, awkward())
    rows = B.token_digests(docs).collect()
    assert len(rows) == len(awkward()) and {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {2}
    assert B.token_digests(docs.limit(0)).collect() == []
