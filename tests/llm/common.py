"""Small tables with awkward rows, and what the tests share."""

import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def documents(spark, texts):
    """Rows from (doc_id, text) with the other columns of documents and two that clash with names used inside."""
    rows = [(i, t, "en", f"s{k % 3}" if k % 4 else None, None, "lane", k) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA + ", lane string, _row int")


def awkward():
    """Nulls, empty, blank, very long, tied and repeated rows."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    return [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, " \t\n"), (None, "a b c d e f"), (None, None), (5, long), (6, long + " end"), (7, "a  b\tc d e f"), (8, "é😀 ü ñ " * 30), (9, "x" * 5000), (10, "A B C D E F")]


def shingles(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def brute_components(rows):
    """{(doc_id, set size, least reachable doc_id)} by comparing all documents that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, k in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {(i, len(sets[i]), find(i)) for i in sets}
