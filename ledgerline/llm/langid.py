"""Language identification: multinomial logistic regression on TF-IDF of character n-grams.

Letters are lower-cased, everything between them is one space; n-grams of one to three
characters are hashed into DIMS buckets. Document frequencies come from all training
documents. Weights are trained by follow-the-regularised-leader with elastic-net penalties
on a bounded sample of them, and a temperature fitted on a part of the sample kept apart
calibrates the probabilities.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import bounded_batches, table
from ledgerline.llm.linear import Ftrl, least
from ledgerline.llm.text_arrays import parts

DIMS = 1 << 15
UNKNOWN = "und"
#: Bounds of the rows fitted, about: in all, while that gives each language the least number, and the most and the least for one language.
SAMPLE, SAMPLE_OF_LANGUAGE, LEAST_OF_LANGUAGE = 4096, 512, 16
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.01, 0.01
#: Code points of a text worked on at once.
SLICE = 1 << 20

_kind = np.zeros(0x110000, np.uint8)  # 0: not looked up yet, 1: letter, 2: other


def _codes(char: np.ndarray, after_letter: bool) -> np.ndarray:
    """Lower-case code points with one space for all between letters; a space at the start only after a letter."""
    kind = _kind[char]
    if not kind.all():
        for c in np.unique(char[kind == 0]):
            _kind[c] = 1 if unicodedata.category(chr(c))[0] in "LM" else 2
        kind = _kind[char]
    letter = kind == 1
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    if len(keep):
        keep[0] |= after_letter
    return np.where(letter, char, np.uint32(32))[keep].astype(np.uint32)


def _buckets(c: np.ndarray, old: int = 1, last: bool = True) -> np.ndarray:
    """Buckets of the n-grams of c that end beyond its first `old` codes; the spaces at both ends of a text are no n-gram of one."""
    a, b, d = c * np.uint32(0x9E3779B1), c * np.uint32(0x85EBCA6B), c * np.uint32(0xC2B2AE35)
    two = a[:-1] ^ (b[1:] + np.uint32(0x27D4EB2F))
    three = two[:-1] ^ (d[2:] + np.uint32(0x165667B1))
    out = np.concatenate([a[old : len(c) - 1 if last else len(c)] + np.uint32(0x61C88647), two[old - 1 :], three[max(old - 2, 0) :]])
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    return (out >> np.uint32(17)).astype(np.int64)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, 1 + ln count) of a text's n-grams; None where it has no letter.

    A long text is counted part by part; the last two codes of a part are carried into the next.
    """
    if not text or not any(unicodedata.category(c)[0] == "L" for c in set(text)):
        return None
    lowered = text.lower()
    counts, tail = np.zeros(DIMS, np.int64), np.array([32], np.uint32)
    for at in range(0, len(lowered), SLICE):
        codes = _codes(np.frombuffer(lowered[at : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32), bool(tail[-1] != 32))
        last = at + SLICE >= len(lowered)
        if last and (codes[-1] if len(codes) else tail[-1]) != 32:
            codes = np.append(codes, np.uint32(32))
        whole = np.concatenate([tail, codes])
        if len(codes):
            counts += np.bincount(_buckets(whole, len(tail), last), minlength=DIMS)
        elif last:
            # the space that ends the text was counted with its part
            counts -= np.bincount(_buckets(np.array([32, 32, 32], np.uint32), 1)[:1], minlength=DIMS)
        tail = whole[-2:]
    some = np.flatnonzero(counts)
    return some, 1 + np.log(counts[some])


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIMS, np.int64), 0
    for batch in parts(batches):
        for text in batch.column(0).to_pylist():
            found = features(text)
            if found is not None:
                df[found[0]] += 1
                n += 1
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], names=["bucket", "df"])


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        rows = [(k, lang, f) for k, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) if (f := features(text)) is not None]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _, _ in rows], pa.int64()), pa.array([x for _, x, _ in rows], pa.string()), pa.array([f[0].astype(np.int32).tobytes() for _, _, f in rows], pa.binary()), pa.array([f[1].astype(np.float32).tobytes() for _, _, f in rows], pa.binary())],
            names=["k", "lang", "buckets", "tf"],
        )


class Model:
    """Names of the languages, inverse document frequencies, weights (DIMS x languages), intercepts and temperature."""

    def __init__(self, names: list[str], idf: np.ndarray, weights: np.ndarray, intercepts: np.ndarray, temperature: float = 1.0):
        self.names, self.idf, self.weights, self.intercepts, self.temperature = names, idf, weights, intercepts, temperature

    def vector(self, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        x = found[1] * self.idf[found[0]]
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def probabilities(self, found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return _softmax((self.vector(found) @ self.weights[found[0]] + self.intercepts) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = features(text)
        if found is None or not self.names:
            return UNKNOWN, 0.0
        p = self.probabilities(found)
        best = int(np.argmax(p))
        return self.names[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit(names: list[str], idf: np.ndarray, rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """rows: (language, buckets, tf) in a fixed order; every fifth calibrates, but not a language's first."""
    model = Model(names, idf, np.zeros((DIMS, len(names))), np.zeros(len(names)))
    place = {n: i for i, n in enumerate(names)}
    sample = [(place[lang], (b, tf)) for lang, b, tf in rows if lang in place]
    train, apart, seen = [], [], set()
    for i, r in enumerate(sample):
        (train if i % 5 or r[0] not in seen else apart).append(r)
        seen.add(r[0])
    ftrl = Ftrl(DIMS + 1, len(names), ALPHA, BETA, L1, L2)
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(EPOCHS):
        for i in order.permutation(len(train)):
            y, found = train[i]
            at = np.append(found[0], DIMS)
            x = np.append(model.vector(found), 1.0)
            w = ftrl.weights(at)
            p = _softmax(x @ w)
            p[y] -= 1
            ftrl.update(at, w, np.outer(x, p))
    model.weights = np.empty((DIMS, len(names)), np.float32)
    for a in range(0, DIMS, 1024):
        model.weights[a : a + 1024] = ftrl.weights(slice(a, a + 1024))[: DIMS - a]
    model.intercepts = ftrl.weights(slice(DIMS, DIMS + 1))[0]
    if apart and len(names) > 1:
        logits = [(y, model.vector(f) @ model.weights[f[0]] + model.intercepts) for y, f in apart]
        loss = lambda log_t: -sum(np.log(max(_softmax(x / np.exp(log_t))[y], 1e-12)) for y, x in logits)
        model.temperature = float(np.exp(least(loss, -3.0, 3.0)))
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training; a row without an id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> Model:
    """Fit on the rows of docs (doc_id, text, lang) that aren't held out and have a lang, and learn every such lang.

    The driver holds 20 bytes x DIMS for each language, and each worker 4.
    """
    bounded_batches(docs.sparkSession)
    labelled = docs.select("doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull())
    languages = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per language
    names = sorted(r["lang"] for r in languages)
    df = np.zeros(DIMS, np.int64)
    n = 0
    for r in labelled.select("text").mapInArrow(_document_frequencies, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect():  # DIMS + 1 rows at most
        if r["bucket"] < 0:
            n = r["df"]
        else:
            df[r["bucket"]] = r["df"]
    idf = np.log((1 + n) / (1 + df)) + 1
    # about so many of each language, by a hash of the id; all of a small one
    each = min(SAMPLE_OF_LANGUAGE, max(LEAST_OF_LANGUAGE, SAMPLE // max(1, len(names))))
    key = F.xxhash64("doc_id", F.lit(9))
    rows = []
    if languages:
        share = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, each / r["n"]) * (1 << 30))) for r in languages], "lang string, share long")
        sample = labelled.withColumn("k", key).join(F.broadcast(share), "lang").filter(F.pmod("k", F.lit(1 << 30)) < F.col("share")).select("k", "lang", "text")
        found = sample.mapInArrow(_sample_features, "k long, lang string, buckets binary, tf binary")
        # of rows with one doc_id and lang one counts
        one = F.min_by(F.struct("buckets", "tf"), F.struct(F.xxhash64("buckets", "tf"), F.length("buckets"))).alias("f")
        found = sorted(found.groupBy("k", "lang").agg(one).select("k", "lang", "f.*").collect(), key=lambda r: (r["k"] % (1 << 30), r["lang"], r["k"]))
        rows = [(r["lang"], np.frombuffer(r["buckets"], np.int32).astype(np.int64), np.frombuffer(r["tf"], np.float32).astype(float)) for r in found]
    return fit(names, idf, rows)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score; one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [model.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame) -> DataFrame:
    """Train on docs and predict for each of its rows; see train() and predict().

    A text that is null or has no letter is `und` with score 0, and so is every text where
    nothing can be learned; repeated rows give repeated rows; an empty table gives an empty
    result; other columns are not read.
    """
    return predict(docs, train(docs))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))
