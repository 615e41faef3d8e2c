"""Document fingerprints by consistent weighted sampling.

The terms of a document are the 5-word shingles that end at each of its words (shorter at
its start), weighted by how often they occur. For each of SAMPLES hash functions every
term draws r and c from Gamma(2, 1) and b from U(0, 1) by its hash alone; with weight S,
t = floor(ln S / r + b), and the term of least ln c - r (t - b + 1) is the sample. Two
documents agree on a sample with a probability equal to the generalised Jaccard
similarity, sum of least weights over sum of greatest, of their terms. The least value
itself names its (term, t), so 16 bits of its hash are the sample's part of the
fingerprint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import bounded_batches, number_rows, table
from ledgerline.llm.text_arrays import U64, mix, parts, word_hashes

SAMPLES = 64
SHINGLE = 5
#: Terms drawn for at once, and code points of text gathered for it.
BLOCK = 1 << 16
SLICE = 1 << 18
_GRID = 1 << 16


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of _GRID equal parts, by Newton's method on 1 - (1 + x) exp(-x)."""
    p = (np.arange(_GRID) + 0.5) / _GRID
    x = np.where(p < 0.3, np.sqrt(2 * p), 1 - np.log(1 - p))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), x / 8)
    return x


_R = _gamma_quantiles().astype(np.float32)
_LN_C = np.log(_gamma_quantiles()).astype(np.float32)
_B = ((np.arange(_GRID) + 0.5) / _GRID).astype(np.float32)
_FAR = np.float32(np.inf)
_STEP = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | U64(1)
_ADD = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) + U64(1 << 40))


def _least(term: np.ndarray, ln_weight: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SAMPLES x segments: the least value of each sample over each segment of terms; infinite where it is empty."""
    out = np.full((SAMPLES, len(starts)), _FAR, np.float32)
    full = np.flatnonzero(ends > starts)
    for a in range(0, len(term), BLOCK):
        g, w = term[a : a + BLOCK], ln_weight[a : a + BLOCK]
        here = full[(starts[full] < a + len(g)) & (ends[full] > a)]
        at = np.maximum(starts[here], a) - a
        plain = not w.any()
        for i in range(SAMPLES):
            z = g * _STEP[i] + _ADD[i]
            z ^= z >> U64(29)
            r, ln_c, b = _R[z >> U64(48)], _LN_C[(z >> U64(32)) & U64(0xFFFF)], _B[(z >> U64(16)) & U64(0xFFFF)]
            t = 0 if plain else np.floor(w / r + b)
            b -= 1
            b -= t
            b *= r
            b += ln_c
            out[i, here] = np.minimum(out[i, here], np.minimum.reduceat(b, at))
    return out


def _weighted(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, counts = np.unique(terms, return_counts=True)
    return unique, np.log(counts).astype(np.float32)


def _terms(words: np.ndarray) -> np.ndarray:
    """The hash of the shingle that ends at each word."""
    padded = np.concatenate([np.full(SHINGLE - 1, U64(0x5BD1E995)), words])
    out = np.zeros(len(words), U64)
    for k in range(SHINGLE):
        out += padded[k : k + len(words)] * U64(pow(0xA24BAED4963EE407, k + 1, 1 << 64))
    return mix(out)


def _hex(least: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """(16-bit samples per row, their hex strings)."""
    bits = (mix(np.ascontiguousarray(least.T).view(np.uint32).astype(np.uint64) + U64(1)) >> U64(48)).astype(np.uint16)
    return bits, [row.astype(">u2").tobytes().hex() for row in bits]


def _words_of(texts: list[str]) -> list[np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    words, counts = word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets)
    return np.split(words, np.cumsum(counts)[:-1])


def sign_pairs(texts: list[str], edited: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, list[str]]:
    """Samples and fingerprints of texts and of their edited forms; terms that both have are drawn for once."""
    with np.errstate(over="ignore"):
        terms, weights, sizes = [], [], []
        for a, b in zip(_words_of(texts), _words_of(edited), strict=True):
            x, y = _terms(a), _terms(b)
            m = min(len(a), len(b))
            same = a[:m] == b[:m]
            q = m if same.all() else int(np.argmin(same))
            sx, sy = np.sort(x), np.sort(y)
            if (sx[1:] == sx[:-1]).any() or (sy[1:] == sy[:-1]).any():
                (x, wx), (y, wy) = _weighted(x), _weighted(y)
                three, ws = (x, x[:0], y), (wx, wx[:0], wy)
                if len(x) == len(y) and (x == y).all() and (wx == wy).all():
                    three, ws = (x[:0], x, x[:0]), (wx[:0], wx, wx[:0])
            else:
                three = x[q:], x[:q], y[q:]
                ws = tuple(np.zeros(len(p), np.float32) for p in three)
            terms += three
            weights += ws
            sizes += [len(p) for p in three]
        ends = np.cumsum(sizes)
        least = _least(np.concatenate(terms), np.concatenate(weights), ends - sizes, ends)
        only, both, other = least[:, 0::3], least[:, 1::3], least[:, 2::3]
        return *_hex(np.minimum(only, both)), *_hex(np.minimum(both, other))


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text."""
    return sign_pairs(texts, texts)[1] if texts else []


def likeness(a: str, b: str) -> float:
    """The share of samples on which two fingerprints agree."""
    return sum(a[k : k + 4] == b[k : k + 4] for k in range(0, 4 * SAMPLES, 4)) / SAMPLES


def edit(text: str, after: str) -> str:
    """text with its last quarter replaced by as many of the first code points of after."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def _sign_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, ahead, doc_id, text) in order; the first row ahead of a part follows its last document."""
    held: list[tuple] = []  # the documents of a part that wait for their next one

    def flush() -> pa.RecordBatch | None:
        ids, texts = [i for i, _ in held], [t for _, t in held]
        changed = [edit(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)] + [texts[-1]]
        x, fx, y, fy = sign_pairs(texts, changed)
        n = len(texts) - 1
        columns = [
            pa.array(ids[:n], id_type),
            pa.array([len(t) for t in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed[:n]], pa.string()),
            pa.array(fx[:n], pa.string()),
            pa.array(fy[:n], pa.string()),
            pa.array((x[:n] == y[:n]).mean(axis=1) if n else [], pa.float64()),
            pa.array((x[:n] == x[1:]).mean(axis=1) if n else [], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    id_type, size, done = None, 0, None
    for batch in parts(batches):
        id_type = batch.column(2).type
        for part, ahead, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if part == done:
                continue
            held.append((doc_id, text or ""))
            size += len(text or "")
            if ahead:
                done = part
            if ahead or size >= SLICE:
                yield flush()
                held, size = ([] if ahead else held[-1:]), (0 if ahead else len(held[-1][1]))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; one row per row of docs.

    The rows are cut by doc_id into as many parts as there are shuffle partitions; each
    part's first row goes to the part before it as well, and texts stream through in order.
    A null text is an empty one; texts without words are alike among themselves and to
    nothing else; rows with equal doc_id follow each other by text, and a null doc_id comes
    first; a lone row is its own next one; an empty table gives an empty result; other
    columns are not read.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    n_parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbered, n = number_rows(docs.select("doc_id"), ["doc_id"])
    step = max(1, -(-n // n_parts))
    marks = [r["doc_id"] for r in numbered.filter(F.col("rn") % step == 0).orderBy("rn").select("doc_id").collect()]  # one per part
    head = marks[0] if marks else None
    found = sorted({m for m in marks if m is not None and m != head})
    cuts = np.array(found, dtype=None if found and isinstance(found[0], int) else object)

    @F.arrow_udf("part int, starts boolean")
    def placed(ids: pa.Array) -> pa.Array:
        there = np.asarray(ids.is_valid())
        values = ids.drop_null().to_numpy(zero_copy_only=False)
        part, starts = np.zeros(len(ids), np.int32), np.zeros(len(ids), bool)
        part[there] = np.searchsorted(cuts, values, side="right")
        some = part > 0
        starts[some] = cuts[part[some] - 1] == values[some[there]]
        return pa.StructArray.from_arrays([pa.array(part), pa.array(starts)], names=["part", "starts"])

    dealt = docs.select("doc_id", "text").withColumn("p", placed("doc_id"))
    own = F.struct(F.col("p.part").alias("part"), F.lit(False).alias("ahead"))
    before = F.when(F.col("p.starts"), F.struct((F.col("p.part") - 1).alias("part"), F.lit(True).alias("ahead")))
    wrapped = F.when(F.col("doc_id").eqNullSafe(F.lit(head)), F.struct(F.lit(len(found)).alias("part"), F.lit(True).alias("ahead")))
    dealt = dealt.select(F.explode(F.array_compact(F.array(own, before, wrapped))).alias("to"), "doc_id", "text").select("to.part", "to.ahead", "doc_id", "text")
    ordered = dealt.repartitionById(len(found) + 1, F.col("part")).sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), "text")
    return ordered.mapInArrow(_sign_sorted, out)


def op3_cws_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
