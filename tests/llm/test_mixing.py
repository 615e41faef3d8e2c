import random
from fractions import Fraction

import numpy as np
import pytest

from ledgerline.llm import mixing as M

from .common import awkward, documents


def brute(weights, blocks, period):
    """Earliest deadline first, slot by slot, phase by phase."""
    left, out = list(blocks), []
    while any(left):
        lanes = [s for s, n in enumerate(left) if n]
        share = dict(zip(lanes, M.shares([weights[s] for s in lanes], period), strict=True))
        size, done, t = sum(share.values()), dict.fromkeys(lanes, 0), 0
        while True:
            ready = [(-(-(done[s] + 1) * size // share[s]), k, s) for k, s in enumerate(lanes) if done[s] * size // share[s] <= t]
            s = min(ready)[2]
            if not left[s]:
                break
            out.append((s, blocks[s] - left[s]))
            left[s] -= 1
            done[s] += 1
            t += 1
    return out


@pytest.mark.parametrize("seed", range(12))
def test_schedule_is_edf_within_a_block_of_target(seed):
    rng = random.Random(seed)
    k = rng.randint(1, 8)
    weights, blocks = [rng.random() + 0.01 for _ in range(k)], [rng.randint(0, 200) for _ in range(k)]
    schedule = M.Schedule(weights, blocks, 100)
    lane = np.repeat(np.arange(k), blocks)
    block = np.concatenate([np.arange(n) for n in blocks])
    _, slot, release, deadline = schedule.place(lane, block)
    assert sorted(slot) == list(range(sum(blocks))) and ((release <= slot) & (slot < deadline)).all()
    order = np.argsort(slot)
    assert [(lane[i], block[i]) for i in order] == brute(weights, blocks, 100)
    for start, places, size, length in schedule.phases:
        had = dict.fromkeys(places, 0)
        for t, i in enumerate(order[start : start + length], 1):
            had[lane[i]] += 1
            assert all(abs(had[s] - places[s][1] / size * t) < 1 for s in places)


def test_long_schedules_keep_the_unrounded_targets():
    for weights in ([0.3337, 0.3331, 0.3332], [1.0, 0.0004, 0.6], [n**0.5 for n in (900_001, 70_003, 1_999, 11)]):
        total = sum(map(Fraction, weights))
        blocks = [int(40_000 * w / sum(weights)) + 1 for w in weights]
        schedule = M.Schedule(weights, blocks)
        lane = np.repeat(np.arange(len(blocks)), blocks)
        _, slot, release, deadline = schedule.place(lane, np.concatenate([np.arange(n) for n in blocks]))
        assert sorted(slot) == list(range(sum(blocks))) and ((release <= slot) & (slot < deadline)).all()
        had = [0] * len(blocks)
        first_phase = next(iter(schedule.phases))[3]
        assert first_phase >= 39_000
        for t, s in enumerate(lane[np.argsort(slot)][:first_phase], 1):
            had[s] += 1
            assert all(abs(h - Fraction(w) / total * t) < 1 for h, w in zip(had, weights, strict=True))


def test_shares_sum_and_are_never_zero():
    for weights in ([1], [1, 1e-9], [0.3, 0.3, 0.4], [5] * 7):
        out = M.shares(weights, 1000)
        assert sum(out) == 1000 and min(out) >= 1


def test_plan_and_order(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    plan, schedule = M.mix(docs, block=8)
    rows = plan.collect()
    assert len(rows) == docs.count() and len({(r.slot, r.place) for r in rows}) == len(rows) and {r.slot for r in rows} == set(range(schedule.slots))
    assert all(r.release <= r.slot < r.deadline for r in rows)
    want = [r.doc_id for r in M.mix(docs)[0].orderBy("slot", "place").collect()]
    assert [r.doc_id for r in M.in_mixed_order(docs).select("doc_id").collect()] == want


def test_weights_and_awkward_rows(spark):
    docs = documents(spark, awkward())
    for weights in (None, {"s1": 0.7, "s2": 0.2, "": 0.1}, {"s1": 1.0}, {}):
        assert M.mix(docs, weights, block=2)[0].count() == len(awkward())
        out = M.in_mixed_order(docs, weights)
        assert out.columns == docs.columns and sorted(map(str, out.select("doc_id", "lane").collect())) == sorted(map(str, docs.select("doc_id", "lane").collect()))
    assert M.in_mixed_order(docs.limit(0)).collect() == [] and M.mix(docs.limit(0))[0].collect() == []


def test_every_source_has_a_lane(spark, monkeypatch):
    rows = [(100 * k + i, "t", None if k == 7 else f"s{k}") for k in range(300) for i in range(1 + (k < 40) * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for most in (M.BROADCAST_IDS, 10):  # lanes broadcast, and shuffled but for the hot
        monkeypatch.setattr(M, "BROADCAST_IDS", most)
        plan, schedule = M.mix(docs, block=1)
        got = plan.collect()
        assert len(got) == len(rows) and len({r.lane for r in got}) == len({r.source for r in got}) == len({(r.lane, r.source) for r in got}) == 300
        assert all(r.release <= r.slot < r.deadline for r in got) and sorted(r.slot for r in got) == list(range(len(rows)))
    want = [r.doc_id for r in M.mix(docs)[0].orderBy("slot", "place").collect()]
    assert [r.doc_id for r in M.in_mixed_order(docs).select("doc_id").collect()] == want


def test_blocks_double_where_there_would_be_too_many(spark, monkeypatch):
    assert M.block_size(0) == M.block_size(64 * M.BLOCKS) == 64 and M.block_size(30_000_000_000) == 8192
    monkeypatch.setattr(M, "BLOCKS", 10)
    rows = [(i, f"t{i}", "en", f"s{i % 2}", 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plan, schedule = M.mix(docs)
    got = plan.collect()
    assert schedule.slots <= 12 and max(r.place for r in got) >= 256 and len({(r.slot, r.place) for r in got}) == 3000
    assert sorted(r.doc_id for r in M.in_mixed_order(docs).collect()) == list(range(3000))
