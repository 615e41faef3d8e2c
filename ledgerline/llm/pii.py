"""Personal data with offset-preserving deobfuscation.

Base identifiers are matched on the text as it is. Then a chain of transducers rewrites a
copy of the text, each keeping, for every character it emits, the source characters that
it stands for: invisible characters go, look-alike letters, digits and signs become ASCII,
runs of digits spelled in English, German, French or Spanish become digits, and words for at and dot become signs. The
same identifiers are matched on the copy, and a match that touches a rewritten stretch and
lies within no base span of its kind is mapped back to the source; base spans that it
reaches beyond, or contains, stay beside it.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.common import bounded_batches, table
from ledgerline.llm.text_arrays import parts

KINDS = ("email", "ip", "card", "phone")
#: As the contract states them.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = str.maketrans(
    "АВЕКМНОРСТХаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρ",
    "ABEKMHOPCTXaeopcyxijsdqwABEZHIKMNOPTYXoavp",
)
#: Characters that are not seen.
INVISIBLE = frozenset("­​‌‍⁠﻿︎️")
#: Digits in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Words for the signs, and which words for a dot go with a bare word for at.
DOT_WORDS = ("dot", "punkt", "point", "punto")
AT_WORDS = {"at": ("dot", "punkt"), "arobase": ("dot", "point"), "arroba": ("dot", "punto")}

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD = f"(?:{'|'.join(sorted(DIGIT_WORDS, key=len, reverse=True))})(?![{_LETTER}])"
_DOT = rf"\x20(?:{'|'.join(DOT_WORDS)})\x20"
_PLUS = r"(?:plus|m[aá]s)[\x20-]+"
#: Numbers in words or numerals on end; only those that make up an identifier's digits are rewritten.
CHAIN = re.compile(rf"(?<![{_LETTER}0-9])(?:(?:{_PLUS})?(?:{_WORD}|[0-9]+))(?:(?:{_DOT}|[\x20,().-]+)(?:{_WORD}|[0-9]+))+(?![{_LETTER}0-9])", re.I)
_LINK = re.compile(rf"(?P<plus>{_PLUS})|(?P<dot>{_DOT})|(?P<word>{_WORD}(?:[\x20,-]+{_WORD})*)|[0-9]+|(?P<gap>[\x20,().-]+)", re.I)
#: Tokens of a text in lower case are its runs of these letters; a chain needs four digits in words, or numerals beside a word for a digit or sign.
_TOKENS = bytes(b if 97 <= b <= 122 or b >= 0xDF and b != 0xF7 else 32 for b in range(256))
_SPELLED = frozenset(w.encode("latin-1") for w in DIGIT_WORDS)
_SPOKEN = _SPELLED | frozenset(w.encode("latin-1") for w in ("plus", "mas", "más", *DOT_WORDS))
_BRACKETED = r"[\x20]*[\[({{<][\x20]*{}[\x20]*[\])}}>][\x20]*"
AT = re.compile(_BRACKETED.format(rf"(?:{'|'.join(AT_WORDS)}|ät|@)"), re.I)
DOT = re.compile(_BRACKETED.format(rf"(?:{'|'.join(DOT_WORDS)}|\.)"), re.I)
_OPENED = tuple(b + w for b in "[({<" for w in (*AT_WORDS, "ät", "@", *DOT_WORDS, ".", " "))
#: A sign for at, as it is or as a bare word, and a host with dots or bare words for them, ending in letters.
TAIL = re.compile(rf"(\x20(?:{'|'.join(AT_WORDS)})\x20|@)([A-Za-z0-9-]+(?:(?:{_DOT}|\.)[A-Za-z0-9-]+)*(?:{_DOT}|\.)[A-Za-z]{{2,}})(?![A-Za-z0-9@-])", re.I)
_BARE_DOT = re.compile(_DOT, re.I)
#: Words that make "at ... dot ..." prose when they stand as a label of the host.
NO_LABEL = frozenset("the a an this that these those each every any some my your his her its our their one all which what noon midnight dot and or then when where here there".split())
#: Words before "at" and a host with real dots that name a place on the web, not a person.
NO_NAME = frozenset("us me you him her it them we i he she they is are was were be been available online found find look looked looking visit see seen read more site website page store here there published live hosted posted out up and or also home back get got shop order app apps blog buy sold sale information details news version free released registered sign join now today work works worked working arrived arrive stay".split())


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # a match starts at the leftmost local character of the run before a sign, so the search starts there
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.start(), m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


_SOME_DIGIT = re.compile("[0-9]")


def find(text: str) -> list[tuple[str, int, int]]:
    """The identifiers of text as (kind, start, end), by kind and then start: leftmost, non-overlapping per kind."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if not _SOME_DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


class Mapped:
    """A rewritten text and, step by step, the ranges that were replaced."""

    def __init__(self, text: str):
        self.text = text
        self.steps: list[tuple[list[int], list[int], list[int], list[int]]] = []  # here from, to; before from, to

    def replace(self, cuts: list[tuple[int, int, str]]) -> None:
        """Replace the ranges, which are in order and apart; each new character stands for its whole range."""
        text, at, shift = [], 0, 0
        here_from, here_to, from_, to = [], [], [], []
        for a, b, new in cuts:
            text += [self.text[at:a], new]
            here_from.append(a + shift)
            shift += len(new) - (b - a)
            here_to.append(b + shift)
            from_.append(a)
            to.append(b)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.steps.append((here_from, here_to, from_, to))

    def source(self, s: int, e: int) -> tuple[int, int, bool]:
        """The source range of text[s:e], and whether any of it was rewritten."""
        touched = False
        for here_from, here_to, from_, to in reversed(self.steps):
            k = bisect_right(here_to, s)  # the first cut that ends beyond s
            touched = touched or k < len(here_from) and here_from[k] < e
            i, j = bisect_right(here_from, s) - 1, bisect_right(here_from, e - 1) - 1
            s = s if i < 0 else from_[i] if s < here_to[i] else s - here_to[i] + to[i]
            e = e if j < 0 else to[j] if e - 1 < here_to[j] else e - here_to[j] + to[j]
        return s, e, touched


def _seen(c: str) -> str:
    """The ASCII form of a look-alike, or c."""
    plain = c.translate(LOOKALIKES)
    if plain != c:
        return plain
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() and folded.isprintable() else c


_folds: dict[str, str] = {}


def _fold(text: str) -> list[tuple[int, int, str]]:
    """Cuts that drop invisible characters and fold look-alikes, wherever they stand."""
    odd = {c for c in set(text) if c > "\x7f"}
    for c in odd:
        if c not in _folds:
            _folds[c] = "" if c in INVISIBLE else _seen(c)
    odd = {c for c in odd if _folds[c] != c}
    if not odd:
        return []
    return [(m.start(), m.end(), _folds[m.group()]) for m in re.finditer("[" + "".join(map(re.escape, sorted(odd))) + "]", text)]


def _may_spell(low: str) -> bool:
    """Whether a text in lower case can hold a chain that _number() rewrites."""
    tokens = low.encode("latin-1", "replace").translate(_TOKENS).split()
    if _SOME_DIGIT.search(low):
        return not _SPOKEN.isdisjoint(tokens)
    return len([t for t in tokens if t in _SPELLED]) >= 4


def _number(chain: re.Match) -> list[tuple[int, int, str]]:
    """Cuts that write a chain's words as digits; none where all are numerals, or too few for a phone, card or address."""
    links = list(_LINK.finditer(chain.group()))
    digits = dots = words = 0
    cuts, at = [], chain.start()
    for k, m in enumerate(links):
        a, b = at + m.start(), at + m.end()
        if m["word"]:
            found = re.findall("[^ ,-]+", m.group().lower())
            digits, words = digits + len(found), words + 1
            cuts.append((a, b, "".join(DIGIT_WORDS[w] for w in found)))
        elif m["plus"]:
            words += 1
            cuts.append((a, b, "+"))
        elif m["dot"]:
            dots, words = dots + 1, words + 1
            cuts.append((a, b, "."))
        elif m["gap"]:
            dots += m.group() == "."
            beside = k and links[k - 1]["word"] or k + 1 < len(links) and links[k + 1]["word"]
            if beside and m.group() != " " and not m.group().strip(" ,-"):
                cuts.append((a, b, " " if "-" not in m.group() else "-"))
        else:
            digits += b - a
    return cuts if words and (digits >= 7 or dots >= 3) else []


def _bare(mapped: Mapped) -> list[tuple[int, int, str]]:
    """Cuts for "at" and "dot" in bare words, each on its own, around a local part and a host."""
    text, cuts, done = mapped.text, [], 0
    for m in TAIL.finditer(text):
        said = {d.group().strip().lower() for d in _BARE_DOT.finditer(m.group(2))}
        words, bare_at, word = bool(said), m.group(1) != "@", m.group(1).strip().lower()
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start == m.start() or not (words or bare_at):
            continue
        if bare_at and not said.issubset(AT_WORDS[word]):
            continue
        labels = re.split(rf"{_DOT}|\.", m.group(2).lower())
        name = text[start : m.start()].lower()
        if bare_at and (NO_LABEL.intersection(labels) or start and text[start - 1] == "@"):
            continue
        if bare_at and not words and (name.strip(".%+-") in NO_NAME or labels[0] == "www") and not mapped.source(*m.span(2))[2]:
            continue
        if bare_at:
            cuts.append((m.start(1), m.end(1), "@"))
        cuts += [(d.start(), d.end(), ".") for d in _BARE_DOT.finditer(text, *m.span(2))]
        done = m.end()
    return cuts


def deobfuscate(text: str) -> Mapped | None:
    """The text with disguises undone, or None when there are none."""
    mapped = Mapped(text)
    steps = 0
    if not text.isascii() and (cuts := _fold(text)):
        mapped.replace(cuts)
        steps += 1
    low = mapped.text.lower()
    if _may_spell(low) and (cuts := [c for m in CHAIN.finditer(mapped.text) for c in _number(m)]):
        mapped.replace(cuts)
        steps += 1
    if any(x in low for x in _OPENED):
        for pattern, sign in ((AT, "@"), (DOT, ".")):
            if cuts := [(m.start(), m.end(), sign) for m in pattern.finditer(mapped.text)]:
                mapped.replace(cuts)
                steps += 1
    if (any(f" {w} " in low for w in AT_WORDS) or "@" in mapped.text and any(f" {w} " in low for w in DOT_WORDS)) and (cuts := _bare(mapped)):
        mapped.replace(cuts)
        steps += 1
    return mapped if steps else None


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a text, in code points, ends exclusive."""
    base = find(text)
    mapped = deobfuscate(text)
    if mapped is None:
        return base, base
    found = list(base)
    taken = {k: [(s, e) for kind, s, e in base if kind == k] for k in KINDS}
    added = dict.fromkeys(KINDS, 0)  # where the last added span of a kind ends
    for kind, s, e in find(mapped.text):
        a, b, touched = mapped.source(s, e)
        k = bisect_right(taken[kind], (a, len(text))) - 1  # the base spans are apart, so the last that starts by a decides
        if touched and a >= added[kind] and (k < 0 or taken[kind][k][1] < b):
            added[kind] = b
            found.append((kind, a, b))
    return base, sorted(found, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        both = [spans(t or "") for t in batch.column(1).to_pylist()]
        counts = [pa.array([sum(k == kind for k, _, _ in found) for _, found in both], pa.int64()) for kind in KINDS]
        digest = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in both], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([_joined(found) for _, found in both], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of all spans), base_sha256, spans; one row per row of docs.

    A null text is an empty one and has no spans; repeated rows give repeated rows; an empty
    table gives an empty result; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_detect, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
