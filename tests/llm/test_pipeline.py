import re

import corpus_pipeline as C
from ledgerline.llm.common import materialise

from .common import awkward, brute_components, documents


def test_stages(spark, root):
    sf = root.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in C.STAGES:
        out = materialise(stage(spark, docs, sf), name)
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        after = {r.doc_id for r in out.select("doc_id").collect()}
        assert after <= set(before)
        if name != "tokens":
            assert out.columns == docs.columns
        if name == "quality":
            labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
            clean = [r.doc_id for r in labels if r.quality and not r.toxic]
            assert sum(i in after for i in clean) >= 0.98 * len(clean)
            assert sum(r.doc_id in after for r in labels if not r.quality) <= 0.05 * len(labels)
        if name == "exact_copies":
            first = {}
            for i, t in before.items():
                k = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
                first[k] = min(first.get(k, i), i)
            assert after == set(first.values())
        if name == "near_copies":
            assert after == {i for i, _, c in brute_components(list(before.items())) if i == c}
        if name in ("mixed", "tokens"):
            assert after == set(before)
        docs = out
    assert C.run(spark, sf).count() == docs.count()


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls, blanks, repeats, long texts and clashing columns pass each stage; an empty table stays empty."""
    docs = documents(spark, awkward())
    schema = "doc_id long, quality int, toxic int"
    spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (99, None, 0)], schema).write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in C.STAGES:
        out = stage(spark, docs, str(tmp_path))
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0 and out.count() <= len(awkward())
        if name == "tokens":
            assert out.count() == len(awkward())
            continue
        assert out.columns == docs.columns == empty.columns
        rows = [tuple(r) for r in out.collect()]
        assert {(r[0], r[1]) for r in rows} <= set(awkward())
        if name == "mixed":
            assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in docs.collect())
        if name == "exact_copies":
            # equal texts: 1, 1, 7 and the row without id; 2, 3 and the other one without; 4 is one space, 10 is in capitals
            assert sorted(r[0] for r in rows if r[0] is not None) == [1, 2, 4, 5, 6, 8, 9, 10]
        if name == "near_copies":
            # rows without words stay; 10 and 7 equal 1 in lower case, and 6 is near 5
            assert {r[0] for r in rows} == {1, 2, 3, 4, 5, 8, 9, None}
