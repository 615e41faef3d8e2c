"""Texts as flat numpy arrays: word hashes and shingles of Arrow string columns, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; temporaries are some 50 times that.
SLICE = 1 << 20
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8) if len(column) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to limit bytes each; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield start, min(end, n)
        start = end


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: What isn't an ASCII letter or part of a character beyond ASCII.
NO_LETTER = np.array([not (chr(b).isalpha() and b < 128 or b >= 128) for b in range(256)])
_rng = np.random.Generator(np.random.PCG64(20260105))
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]
BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        inverse = pow(BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[size] = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)])) for b in (BASE, inverse))
    return _powers[size]


def _hash_slice(data: np.ndarray, table: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    forward, backward = _power_tables(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(table[data] * forward[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * backward[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE, head: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word in lower case, number of words of each row); apart: the bytes between words.

    head: hash only so many of a word's first bytes. By default words are `[^\\x20\\x09-\\x0D]+`. Only A-Z are lowered. Long rows are hashed
    slice by slice, cut between words, so memory follows the words.
    """
    table = LOWER
    hashes, starts, at, n = [], [], 0, len(data)
    row_start = np.zeros(n + 1, bool)
    row_start[offsets[:-1][offsets[:-1] < n]] = True
    while at < n:
        end = min(n, at + SLICE)
        while end < n and not (apart[data[end - 1]] or row_start[end]):
            ahead = data[end : end + SLICE]
            stops = np.flatnonzero(apart[ahead] | row_start[end : end + len(ahead)])
            end = end + (int(stops[0]) + (1 if apart[ahead[stops[0]]] else 0) if stops.size else len(ahead))
        part = data[at:end]
        inside = ~apart[part]
        first = inside.copy()
        first[1:] &= apart[part[:-1]] | row_start[at + 1 : end]
        s = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= apart[part[1:]] | row_start[at + 1 : end]
        e = np.flatnonzero(last) + 1
        hashes.append(_hash_slice(part, table, s, e if head is None else np.minimum(e, s + head)))
        starts.append(s + at)
        at = end
    where = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(where, offsets)) if len(where) else np.zeros(len(offsets) - 1, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, U64)), counts


def shingle_sets(words: np.ndarray, counts: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Each row's distinct shingles of size words, as sorted 64-bit hashes; fewer words are one shingle; none give an empty set."""
    starts = np.concatenate([[0], np.cumsum(counts)])
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(words) - size + 1), U64)
        for k in range(size):
            full += words[k : k + len(full)] * U64(pow(0xA24BAED4963EE407, k + 1, 1 << 64))
        full = mix(full)
        out = []
        for i, n in enumerate(counts):
            if n >= size:
                g = np.sort(full[starts[i] : starts[i] + n - size + 1])
                keep = np.ones(len(g), bool)
                np.not_equal(g[1:], g[:-1], out=keep[1:])
                out.append(g[keep])
            elif n:
                h = U64(0x632BE59BD9B4E019) * U64(n)
                for w in words[starts[i] : starts[i] + n]:
                    h = mix(np.array([h * U64(0x9FB21C651E98DF25) + w]))[0]
                out.append(np.array([h], U64))
            else:
                out.append(np.zeros(0, U64))
    return out


def sets_of(column: pa.Array, size: int = 5) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(index of the first row, shingle sets) for slices of the column."""
    data, offsets = buffers(column)
    for a, b in groups(offsets):
        words, counts = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, shingle_sets(words, counts, size)
