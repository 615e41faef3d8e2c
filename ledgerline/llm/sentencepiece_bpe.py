"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A slice of the corpus becomes one flat array of symbols, one per code point, of its
distinct words (a word starts at a space mark that follows another character; no piece
crosses that). In each round every word finds its best pair by a segmented minimum of
ranks, all words merge at once, leftmost first, and the arrays are compacted; words
without a pair left are set aside, until none remains.

All occurrences of the best pair of a word merge in one round where that equals merging
them one by one: when no merge with the merged piece ranks before it. For other ranks
(checked when the model is read) only the leftmost occurrence merges. Words longer than
LONG symbols are merged by a heap instead, so that no word needs many rounds.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.common import bounded_batches, table
from ledgerline.llm.text_arrays import U64, _power_tables, mix, parts

MARK = "▁"
LONG = 512
#: Code points encoded at once.
SLICE = 1 << 18
NONE = np.int32(2**31 - 1)
CODE_BITS = 21
_WORD_START = re.compile(f"(?<=[^ {MARK}])[ {MARK}]")
codecs.register_error("ledgerline_each", lambda e: ("�" * (e.end - e.start), e.end))


def default_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


class Pieces:
    """The tables of a model: BPE, identity normaliser, dummy prefix, byte fallback."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        assert sp.normalize("  Aﬁ ") == f"{MARK * 3}Aﬁ{MARK}", "the normaliser must be the identity with a dummy prefix"
        self.size = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        piece = [sp.id_to_piece(i) for i in range(self.size)]
        normal = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte = np.full(256, -1, np.int64)
        for i in range(self.size):
            if sp.is_byte(i):
                self.byte[int(piece[i][3:5], 16)] = i
        assert (self.byte >= 0).all(), "byte fallback is needed"
        assert not any(MARK in piece[i].lstrip(MARK) for i in normal), "a piece crosses a word start"

        #: Symbol of a code point: its piece, else size + code point.
        self.of_char = np.arange(0x110000, dtype=np.int32) + self.size
        ids = {piece[i]: i for i in normal}
        for text, i in ids.items():
            if len(text) == 1:
                self.of_char[ord(text)] = i
        scores = sorted({sp.get_score(i) for i in normal}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        rank = {text: place[sp.get_score(i)] for text, i in ids.items()}
        symbol = lambda t: int(self.of_char[ord(t)]) if len(t) == 1 else ids.get(t)
        merges, unsafe = [], np.zeros(len(scores) + 1, bool)
        seen = set()
        for text in ids:
            if len(text) > 1:
                if rank[text] in seen:
                    unsafe[rank[text]] = True
                seen.add(rank[text])
            for cut in range(1, len(text)):
                left, right = symbol(text[:cut]), symbol(text[cut:])
                if left is not None and right is not None:
                    merges.append(((left << CODE_BITS) | right, rank[text], ids[text]))
                    for part in (text[:cut], text[cut:]):
                        if len(part) > 1 and rank[text] <= rank[part]:
                            unsafe[rank[part]] = True
        merges.sort()
        self.keys = np.array([m[0] for m in merges], np.int64)
        self.ranks = np.array([m[1] for m in merges], np.int32)
        self.merged = np.array([m[2] for m in merges], np.int32)
        self.unsafe = unsafe
        # a small table settles most lookups before the search: whether any key has this hash
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self._slot(self.keys)] = True

        surface = [b"" if sp.is_control(i) else " ⁇ ".encode() if i == self.unk else bytes([int(piece[i][3:5], 16)]) if sp.is_byte(i) else piece[i].replace(MARK, " ").encode() for i in range(self.size)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_at = np.concatenate([[0], np.cumsum([len(s) for s in surface])])
        self.control = np.array([sp.is_control(i) for i in range(self.size)])
        self.marked = np.array([piece[i].startswith(MARK) and not sp.is_control(i) for i in range(self.size)])

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(42)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of symbol pairs; rank NONE where they don't merge."""
        keys = (left.astype(np.int64) << CODE_BITS) | right
        rank, merged = np.full(len(keys), NONE, np.int32), np.full(len(keys), -1, np.int32)
        likely = np.flatnonzero(self.maybe[self._slot(keys)])
        at = np.minimum(np.searchsorted(self.keys, keys[likely]), len(self.keys) - 1)
        found = self.keys[at] == keys[likely]
        rank[likely[found]], merged[likely[found]] = self.ranks[at[found]], self.merged[at[found]]
        return rank, merged


_loaded: dict[bytes, Pieces] = {}


def pieces_of(model: bytes) -> Pieces:
    key = hashlib.sha256(model).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(model)
    return _loaded[key]


def _merge_by_heap(pieces: Pieces, symbols: np.ndarray) -> list[int]:
    """One long word: the pair of best rank, leftmost on a tie, merges until none is left."""
    sym = symbols.tolist()
    n = len(sym)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    rank, merged = pieces.look_up(symbols[:-1], symbols[1:])
    heap = [(int(rank[i]), int(i), sym[i], sym[i + 1], int(merged[i])) for i in np.flatnonzero(rank != NONE)]
    heapq.heapify(heap)
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def push(i: int) -> None:
        if i >= 0 and (j := after[i]) >= 0:
            pair = (sym[i], sym[j])
            if pair not in known:
                r, m = pieces.look_up(np.array([pair[0]]), np.array([pair[1]]))
                known[pair] = int(r[0]), int(m[0])
            r, m = known[pair]
            if r != NONE:
                heapq.heappush(heap, (r, i, *pair, m))

    while heap:
        _, i, left, right, m = heapq.heappop(heap)
        if sym[i] != left or (j := after[i]) < 0 or sym[j] != right:
            continue
        sym[i], sym[j] = m, -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        push(before[i])
        push(i)
    return [s for s in sym if s >= 0]


def merge_words(pieces: Pieces, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols after all merges, their number per word); lengths: symbols of each word, 1 or more."""
    word = np.repeat(np.arange(len(lengths)), lengths)
    done_word, done_symbol = [], []
    if (lengths > LONG).any():
        ends = np.cumsum(lengths)
        for w in np.flatnonzero(lengths > LONG):
            out = _merge_by_heap(pieces, symbols[ends[w] - lengths[w] : ends[w]])
            done_symbol.append(np.array(out, np.int32))
            done_word.append(np.full(len(out), w))
        keep = lengths[word] <= LONG
        word, symbols = word[keep], symbols[keep]

    def ranked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of the pairs that begin at these places."""
        rank, merged = np.full(len(at), NONE, np.int32), np.full(len(at), -1, np.int32)
        pair = np.flatnonzero(at + 1 < len(word))
        pair = pair[word[at[pair]] == word[at[pair] + 1]]
        rank[pair], merged[pair] = pieces.look_up(symbols[at[pair]], symbols[at[pair] + 1])
        return rank, merged

    rank, merged = ranked(np.arange(len(word)))
    while len(word):
        begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        best = np.minimum.reduceat(rank, begins)
        sizes = np.diff(np.concatenate([begins, [len(word)]]))
        if (best == NONE).any():
            out = np.repeat(best == NONE, sizes)
            done_word.append(word[out])
            done_symbol.append(symbols[out])
            word, symbols, rank, merged = word[~out], symbols[~out], rank[~out], merged[~out]
            best, sizes = best[best != NONE], sizes[best != NONE]
            if not len(word):
                break
            begins = np.cumsum(sizes) - sizes
        at = np.flatnonzero(rank == np.repeat(best, sizes))
        # of pairs that overlap every second one merges, of an unsafe rank the first in the word
        new_run = np.concatenate([[True], at[1:] != at[:-1] + 1])
        in_run = np.arange(len(at)) - np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        of = word[at]
        first = np.concatenate([[True], of[1:] != of[:-1]])
        at = at[np.where(pieces.unsafe[rank[at]], first, in_run % 2 == 0)]
        symbols[at] = merged[at]
        keep = np.ones(len(word), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        word, symbols, rank, merged = word[keep], symbols[keep], rank[keep], merged[keep]
        changed = moved[at]
        changed = np.unique(np.concatenate([changed, changed[changed > 0] - 1]))
        rank[changed], merged[changed] = ranked(changed)
    word, symbols = np.concatenate(done_word), np.concatenate(done_symbol)
    order = np.argsort(word, kind="stable")
    return symbols[order], np.bincount(word, minlength=len(lengths))


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges of flat laid end to end."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def _bytes_of(pieces: Pieces, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols without a piece become the byte pieces of their character."""
    odd = np.flatnonzero(symbols >= pieces.size)
    if not odd.size:
        return symbols, counts
    width = np.ones(len(symbols), np.int64)
    encoded = [chr(c).encode() for c in symbols[odd] - pieces.size]
    width[odd] = [len(e) for e in encoded]
    ends = np.cumsum(width)
    out = np.repeat(symbols, width)
    out[_gather(np.arange(len(out)), (ends - width)[odd], width[odd])] = pieces.byte[np.frombuffer(b"".join(encoded), np.uint8)]
    word = np.repeat(np.arange(len(counts)), counts)
    return out, np.bincount(word, weights=width, minlength=len(counts)).astype(np.int64)


def encode_marked(pieces: Pieces, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids per text) of texts that begin at a word start, the dummy prefix included; no begin or end ids."""
    lengths = np.array([len(t) for t in texts], np.int64)
    char = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).copy()
    if not len(char):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    char[char == 32] = ord(MARK)
    marks = char == ord(MARK)
    start = marks.copy()
    start[1:] &= ~marks[:-1]
    ends = np.cumsum(lengths)
    start[(ends - lengths)[lengths > 0]] = True
    at = np.flatnonzero(start)
    size = np.diff(np.concatenate([at, [len(char)]]))
    # distinct words by a 64-bit hash
    forward, backward = _power_tables(len(char))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(char) + 1, U64)
        np.cumsum(mix(char.astype(U64) + U64(1)) * forward[: len(char)], out=sums[1:])
        key = mix((sums[at + size] - sums[at]) * backward[at] + size.astype(U64))
    _, index, inverse = np.unique(key, return_index=True, return_inverse=True)
    symbols, counts = merge_words(pieces, pieces.of_char[_gather(char, at[index], size[index])], size[index])
    symbols, counts = _bytes_of(pieces, symbols, counts)
    word_at = np.cumsum(counts) - counts
    ids = _gather(symbols, word_at[inverse], counts[inverse])
    text = np.searchsorted(ends, at, side="right")
    return ids, np.bincount(text, weights=counts[inverse], minlength=len(texts)).astype(np.int64)


def segments(text: str, limit: int = SLICE) -> Iterator[str]:
    """The marked text in parts that begin at word starts."""
    if not text:
        return
    text, at = MARK + text, 0
    while len(text) - at > limit:
        cut = _WORD_START.search(text, at + limit)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def decode(pieces: Pieces, ids: np.ndarray, first: bool = True) -> str:
    """The text of ids: control ids are nothing, and the first piece loses its dummy space."""
    ids = np.asarray(ids)
    at = pieces.surface_at[ids]
    out = _gather(pieces.surface, at, pieces.surface_at[ids + 1] - at).tobytes()
    shown = ids[~pieces.control[ids]][:1] if first else ids[:0]
    if shown.size and pieces.marked[shown[0]]:
        out = out[1:]
    return out.decode("utf-8", errors="ledgerline_each")


def encode_texts(pieces: Pieces, texts: list[str], limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, bool, bool]]:
    """(index of the text, ids, first, last): the parts of each text's ids in order, begin and end ids included."""
    held: list[tuple[int, str, bool, bool]] = []
    size = 0

    def flush() -> Iterator[tuple[int, np.ndarray, bool, bool]]:
        ids, counts = encode_marked(pieces, [t for _, t, _, _ in held])
        ends = np.cumsum(counts)
        for (i, _, first, last), a, b in zip(held, ends - counts, ends, strict=True):
            yield i, np.concatenate([[pieces.bos] if first else [], ids[a:b], [pieces.eos] if last else []]).astype(np.uint32), first, last

    for i, text in enumerate(texts):
        cut = iter([*segments(text, limit)] or [""])
        part, first = next(cut), True
        while part is not None:
            after = next(cut, None)
            held.append((i, part, first, after is None))
            size += len(part)
            part, first = after, False
            if size >= limit:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def encode(pieces: Pieces, texts: list[str]) -> list[np.ndarray]:
    """The ids of each text, begin and end ids included."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for i, ids, _, _ in encode_texts(pieces, texts):
        found[i].append(ids)
    return [np.concatenate(p) for p in found]


def _digests(model: bytes):
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in parts(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, of_ids, of_text = np.zeros(len(texts), np.int64), [], []
            for i, ids, first, last in encode_texts(pieces, texts):
                if first:
                    ids_hash, text_hash = hashlib.sha256(), hashlib.sha256()
                n[i] += len(ids)
                ids_hash.update(ids.astype("<u4").tobytes())
                text_hash.update(decode(pieces, ids.astype(np.int64), first).encode())
                if last:
                    of_ids.append(ids_hash.hexdigest())
                    of_text.append(text_hash.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digests


def _encode_batches(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in parts(batches):
            ids = encode(pieces, [t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decode_batches(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in parts(batches):
            texts = [decode(pieces, np.array(i or [], np.int64)) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _id_type(df: DataFrame) -> str:
    bounded_batches(df.sparkSession)
    return f"doc_id {df.schema['doc_id'].dataType.simpleString()}"


def encode_documents(docs: DataFrame, model: bytes | None = None) -> DataFrame:
    """doc_id, ids (array<int>, with begin and end ids); one row per row of docs, see token_digests()."""
    return docs.select("doc_id", "text").mapInArrow(_encode_batches(model or default_model()), f"{_id_type(docs)}, ids array<int>")


def decode_documents(encoded: DataFrame, model: bytes | None = None) -> DataFrame:
    """doc_id, text; a null array decodes to an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode_batches(model or default_model()), f"{_id_type(encoded)}, text string")


def token_digests(docs: DataFrame, model: bytes | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; one row per row of docs.

    A null or empty text has the begin and end ids alone; repeated rows give repeated rows;
    an empty table gives an empty result; other columns are not read.
    """
    return docs.select("doc_id", "text").mapInArrow(_digests(model or default_model()), f"{_id_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))
