"""Quality by ordinal cumulative-link regression on graded ratings.

A rating has a grade from 0: quality plus freedom from toxicity. Texts become hashed
features: each distinct word and beginning of a word under HASHES hashes, and bands of shape (how much of the text
is each sign, capitals, digits, words said twice in a row). One shared weight vector w
scores a text, and ordered thresholds cut the score into grades: P(grade <= k) is
logistic(threshold_k - w x). Selection goes by the expected grade and by the probability
of the top grade.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import bounded_batches, table
from ledgerline.llm.linear import Ftrl
from ledgerline.llm.text_arrays import NO_LETTER, SLICE, U64, buffers, groups, mix, word_hashes

DIMS = 1 << 20
#: Buckets of each word. A word that shares one of them with a telling word gets only its part of the weight.
HASHES = 3
#: Beginnings of words, in bytes, that are features too.
PREFIXES = (5, 8)
GRADES = 3
#: Bound of the fit: ratings in the training sample, about.
SAMPLE = 6000
EPOCHS = 8
ALPHA, BETA, L1, L2 = 0.2, 1.0, 15.0, 1.0
#: Draws for the sample lie in 0 .. RANGE - 1.
RANGE = 1 << 30
#: Step of the thresholds.
RATE = 0.1
#: A document stays when the top grade is at least so likely.
KEEP = 0.7

_SIGNS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_SHAPES = len(_SIGNS) + 4


def _bands(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """0 for none, else a band of the share, by powers of two from 1/256."""
    share = part / np.maximum(whole, 1)
    return np.where(part > 0, np.clip(np.floor(np.log2(np.maximum(share, 2.0**-9))) + 10, 1, 10), 0).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The distinct terms of each row of a slice of texts, as 32-bit keys."""
    words, counts = word_hashes(data, offsets, NO_LETTER)
    begun = [word_hashes(data, offsets, NO_LETTER, k)[0] for k in PREFIXES]
    ends = np.cumsum(counts)
    out = []
    for i, (b, n) in enumerate(zip(ends, counts, strict=True)):
        own, raw = words[b - n : b], np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256)
        size = raw.sum()
        twice = int((own[1:] == own[:-1]).sum())
        distinct = np.unique(own)
        begins = [np.unique(x[b - n : b]) + U64(k << 40) for k, x in zip(PREFIXES, begun, strict=True)]
        part = np.concatenate([raw[_SIGNS], [raw[65:91].sum(), raw[48:58].sum(), twice, n - len(distinct)]])
        whole = np.concatenate([np.full(len(_SIGNS) + 2, size), [n, n]])
        shape = np.arange(_SHAPES, dtype=np.uint64) * U64(64) + _bands(part, whole).astype(np.uint64)
        with np.errstate(over="ignore"):
            terms = np.concatenate([distinct, *begins, mix(shape + U64(0x51ED270B))])
        out.append((terms >> U64(32)).astype(np.uint32))
    return out


def spread(keys: np.ndarray) -> np.ndarray:
    """The distinct buckets of terms, HASHES of each."""
    with np.errstate(over="ignore"):
        hashes = np.concatenate([mix(keys + U64(k * 0x9E3779B97F4A7C15 % 2**64)) for k in range(HASHES)])
    return np.unique((hashes >> U64(44)).astype(np.int32) % np.int32(DIMS))


def _features_of(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    data, offsets = buffers(column)
    for a, b in groups(offsets, SLICE):
        yield a, features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def grade_probabilities(self, score: np.ndarray) -> np.ndarray:
        """rows x grades."""
        upto = _sigmoid(self.thresholds[None, :] - np.asarray(score)[:, None])
        return np.diff(np.concatenate([np.zeros((len(upto), 1)), upto, np.ones((len(upto), 1))], axis=1), axis=1)

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[spread(r)].sum() for r in rows], float)


def gradients(score: np.ndarray, grade: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the loss -ln P(grade) of each row: (by its score, by each threshold)."""
    upto = _sigmoid(cut[None, :] - score[:, None])
    bounds = np.concatenate([np.zeros((len(score), 1)), upto, np.ones((len(score), 1))], axis=1)
    rows = np.arange(len(score))
    p = np.maximum(bounds[rows, grade + 1] - bounds[rows, grade], 1e-9)
    density = upto * (1 - upto) / p[:, None]
    k = np.arange(len(cut))[None, :]
    by_cut = np.where(k == grade[:, None], -density, 0.0) + np.where(k == grade[:, None] - 1, density, 0.0)
    return -by_cut.sum(axis=1), by_cut


def ordered(free: np.ndarray) -> np.ndarray:
    """Thresholds from the first and the logarithms of the steps to the next ones: always in order."""
    return free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def fit(rows: Iterable[tuple[int, np.ndarray]]) -> Model:
    """rows: (grade, distinct buckets) in a fixed order. Without ratings every text has the top grade.

    Follow-the-regularised-leader, row by row, over the buckets that can matter: as a
    gradient is 1 at most, a bucket in so few rows that even EPOCHS gradients of each don't exceed
    L1 keeps weight zero, and isn't carried. The buckets of all rows lie in one array.
    """
    grades, ends, held, size = [], [], np.empty(1 << 16, np.int32), 0
    for g, at in rows:
        if size + len(at) > len(held):
            held.resize(max(2 * len(held), size + len(at)), refcheck=False)
        held[size : size + len(at)] = at
        size += len(at)
        grades.append(g)
        ends.append(size)
    if not grades:
        return Model(np.zeros(DIMS, np.float32), np.arange(GRADES - 1, dtype=float) - 40)
    grade = np.array(grades)
    shares = np.cumsum([(grade == k).sum() + 1 for k in range(GRADES - 1)]) / (len(grade) + GRADES)
    first = np.log(shares / (1 - shares))
    free = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    squares = np.full(len(free), 1e-8)

    seen = np.zeros(DIMS, np.int32)
    for a in range(0, size, 1 << 20):
        seen += np.bincount(held[a : min(size, a + (1 << 20))], minlength=DIMS).astype(np.int32)
    kept = np.flatnonzero(seen * EPOCHS > L1)
    kept = kept[np.argsort(-seen[kept], kind="stable")]  # the frequent ones close together
    place = np.full(DIMS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    bounds, size = [0], 0
    for a, b in zip([0, *ends], ends, strict=False):
        own = place[held[a:b]]
        own = np.sort(own[own >= 0])
        held[size : size + len(own)] = own
        size += len(own)
        bounds.append(size)
    ftrl = Ftrl(len(kept), 1, ALPHA, BETA, L1, L2)
    order = np.random.Generator(np.random.PCG64(11))
    for _ in range(EPOCHS):
        for i in order.permutation(len(grade)):
            at = held[bounds[i] : bounds[i + 1]]
            w = ftrl.weights(at)
            by_score, by_cut = gradients(w.sum(axis=0), grade[i : i + 1], ordered(free))
            ftrl.update(at, w, by_score[:, None])
            # the first moves every threshold, a step all from its own on
            d_free = np.concatenate([[by_cut.sum()], np.cumsum(by_cut[0, ::-1])[::-1][1:] * np.exp(free[1:])])
            squares += d_free**2
            free -= RATE * d_free / np.sqrt(1 + squares)
    weights = np.zeros(DIMS, np.float32)
    weights[kept] = ftrl.weights(slice(None))[:, 0]
    return Model(weights, ordered(free))


def _rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, rows in _features_of(batch.column(2)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(rows)), batch.column(1).slice(a, len(rows)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["k", "grade", "terms"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on docs (doc_id, text) with labels (doc_id, quality 0/1, toxic 0/1).

    Of several labels of one doc_id the lowest quality and highest toxicity count; labels
    with a null are left out. Beyond SAMPLE ratings a share of them is taken by a hash of
    the id, about SAMPLE in all. Of several rows with a rated doc_id one counts, by its text.
    """
    return fit(_sample(docs, ratings(labels)))


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id, grade of all labels without a null."""
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    return known.groupBy("doc_id").agg((F.min("quality") + 1 - F.max("toxic")).cast("int").alias("grade"))


def _sample(docs: DataFrame, rated: DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """(grade, buckets) of about SAMPLE docs with a rating, one for each doc_id, in a fixed order."""
    bounded_batches(docs.sparkSession)
    n = rated.count()
    part = int(min(1.0, SAMPLE / max(n, 1)) * RANGE)
    some = rated.withColumn("k", F.xxhash64("doc_id", F.lit(5))).filter(F.pmod("k", F.lit(RANGE)) < part)
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("k", "grade", "text")  # about SAMPLE ratings
    terms = found.mapInArrow(_rated, "k long, grade int, terms binary")
    rows = terms.groupBy("k", "grade").agg(F.min_by("terms", F.struct(F.xxhash64("terms"), F.length("terms"))).alias("terms")).collect()
    rows.sort(key=lambda r: (r["k"] % RANGE, r["grade"], r["k"]), reverse=True)
    while rows:
        r = rows.pop()
        yield r["grade"], spread(np.frombuffer(r["terms"], np.uint32))


def held_out(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """(a model of four fifths of the ratings, by a hash of the id; doc_id, grade, expected_grade, tail_probability, kept of the rest)."""
    rated = ratings(labels)
    apart = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(5)) == 0
    model = fit(_sample(docs, rated.filter(~apart)))
    rest = docs.select("doc_id", "text").join(rated.filter(apart), "doc_id")
    return model, rate(rest, model).select("row.doc_id", "row.grade", "expected_grade", "tail_probability", "kept")


def rate(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """row, a struct of the columns of docs, with expected_grade, tail_probability and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS weights

    @F.arrow_udf("expected_grade double, tail_probability double")
    def rated(text: pa.Array) -> pa.Array:
        model = shared.value
        scores = np.concatenate([np.zeros(0), *(model.scores(rows) for _, rows in _features_of(text))])
        p = model.grade_probabilities(scores)
        return pa.StructArray.from_arrays([pa.array(p @ np.arange(GRADES)), pa.array(p[:, -1])], names=["expected_grade", "tail_probability"])

    r = docs.select(F.struct(*docs.columns).alias("row"), rated("text").alias("r"))
    return r.select("row", "r.*").withColumn("kept", F.col("tail_probability") >= keep)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade (0 to 2), tail_probability (of the top grade), kept; one row per row of docs.

    A null text is rated as an empty one; repeated rows give repeated rows; without labels
    every row is kept; an empty table gives an empty result; other columns are not read.
    """
    rated = rate(docs.select("doc_id", "text"), train(docs, labels))
    return rated.select("row.doc_id", "expected_grade", "tail_probability", "kept")


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that classify() doesn't keep.

    A null text is rated as an empty one, a missing doc_id doesn't matter, repeated rows are kept or
    dropped together; without labels all stay; an empty table stays empty; other columns go along.
    """
    return rate(docs, train(docs, labels)).filter("kept").select("row.*")


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
