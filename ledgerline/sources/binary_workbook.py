"""Binary workbooks (BIFF8 in a compound file): cells of every sheet, a small writer, and amounts of printed forms.

A compound file is sectors chained by an allocation table; its stream `Workbook` is a run of
records (kind, length, body). Shared strings may go on in the next record, in the middle of
the characters too.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
END, FREE, FAT_SECTOR = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD
# record kinds, fixed by the format
FORMULA, END_OF_PART, CONTINUE, BOUND_SHEET, MANY_RK, MANY_BLANK, SHARED_STRINGS, SHARED_TEXT, BLANK, NUMBER, TEXT, TRUTH, FORMULA_TEXT, RK, BEGIN = 0x06, 0x0A, 0x3C, 0x85, 0xBD, 0xBE, 0xFC, 0xFD, 0x201, 0x203, 0x204, 0x205, 0x207, 0x27E, 0x809


def stream(data: bytes, name: str = "Workbook") -> bytes:
    """The named stream of a compound file; ValueError where the file is none or damaged."""
    if data[:8] != MAGIC or len(data) < 512:
        raise ValueError("not a compound file")
    big, small = (1 << x for x in struct.unpack_from("<HH", data, 30))
    directory, _, cutoff, small_table, _, more, _ = struct.unpack_from("<7I", data, 48)
    sector = lambda i: data[(i + 1) * big : (i + 2) * big]
    places = [x for x in struct.unpack_from("<109I", data, 76) if x < FAT_SECTOR]
    while more < FAT_SECTOR:
        *own, more = struct.unpack(f"<{big // 4}I", sector(more))
        places += [x for x in own if x < FAT_SECTOR]
    table = [x for p in places for x in struct.unpack(f"<{big // 4}I", sector(p))]

    def chain(start: int, links: list[int]) -> Iterator[int]:
        seen = 0
        while start < FAT_SECTOR:
            if start >= len(links) or seen > len(links):
                raise ValueError("damaged compound file")
            yield start
            start, seen = links[start], seen + 1

    whole = lambda start: b"".join(sector(i) for i in chain(start, table))
    entries = whole(directory)
    found = root = None
    for at in range(0, len(entries), 128):
        size = struct.unpack_from("<H", entries, at + 64)[0]
        title, kind = entries[at : at + max(size - 2, 0)].decode("utf-16-le"), entries[at + 66]
        place = struct.unpack_from("<II", entries, at + 116)
        if kind == 5:
            root = place
        elif kind == 2 and title == name:
            found = place
    if found is None:
        raise ValueError(f"no stream {name!r}")
    if found[1] >= cutoff or root is None:
        return whole(found[0])[: found[1]]
    body, links = whole(root[0]), [x for i in chain(small_table, table) for x in struct.unpack(f"<{big // 4}I", sector(i))]
    return b"".join(body[i * small : (i + 1) * small] for i in chain(found[0], links))[: found[1]]


def records(book: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(book):
        kind, size = struct.unpack_from("<HH", book, at)
        yield kind, book[at + 4 : at + 4 + size]
        at += 4 + size


class _Pieces:
    """A record and the ones that go on with it, read as one; characters that go on bring their width anew."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.i, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.at == len(self.parts[self.i]):
                self.i, self.at = self.i + 1, 0
            got = self.parts[self.i][self.at : self.at + n - len(out)]
            self.at += len(got)
            out += got
        return out

    def characters(self, n: int, wide: bool) -> str:
        out = ""
        while len(out) < n:
            if self.at == len(self.parts[self.i]):
                self.i, self.at = self.i + 1, 1
                wide = bool(self.parts[self.i][0] & 1)
            step = 2 if wide else 1
            count = min(n - len(out), (len(self.parts[self.i]) - self.at) // step)
            if count <= 0:
                raise ValueError("a character is cut")
            raw = self.parts[self.i][self.at : self.at + count * step]
            out += raw.decode("utf-16-le", "surrogatepass") if wide else raw.decode("latin-1")
            self.at += count * step
        return out


def _shared(parts: list[bytes]) -> list[str]:
    p, out = _Pieces(parts), []
    _, n = struct.unpack("<II", p.take(8))
    for _ in range(n):
        size, flags = struct.unpack("<HB", p.take(3))
        runs = struct.unpack("<H", p.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", p.take(4))[0] if flags & 4 else 0
        out.append(p.characters(size, bool(flags & 1)))
        p.take(4 * runs + extra)
    return out


def _text(body: bytes, at: int) -> str:
    size, flags = struct.unpack_from("<HB", body, at)
    return _Pieces([body[at + 3 :]]).characters(size, bool(flags & 1))


def _rk(x: int) -> float:
    value = float(x >> 2 if x < 1 << 31 else (x >> 2) - (1 << 30)) if x & 2 else struct.unpack("<d", struct.pack("<Q", (x & 0xFFFFFFFC) << 32))[0]
    return value / 100 if x & 1 else value


def _plain(v: float) -> str:
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)


def column_name(c: int) -> str:
    return (column_name(c // 26 - 1) if c >= 26 else "") + chr(65 + c % 26)


def cells(data: bytes) -> list[tuple[str, int, str, str | None]]:
    """(sheet, row from 1, column letters, text) of every cell with a content; a formula gives its stored result."""
    book = stream(data)
    sheets, shared, pieces = [], [], None
    for kind, body in records(book):
        if kind == CONTINUE and pieces is not None:
            pieces.append(body)
            continue
        if pieces is not None:
            shared, pieces = _shared(pieces), None
        if kind == SHARED_STRINGS:
            pieces = [body]
        elif kind == BOUND_SHEET and body[5] == 0:  # worksheets
            sheets.append((_Pieces([body[8:]]).characters(body[6], bool(body[7] & 1)), struct.unpack_from("<I", body)[0]))
        elif kind == END_OF_PART:
            break
    out = []
    for name, start in sheets:
        waiting = None  # a formula whose text is in the next record
        for kind, body in records(book, start):
            if kind == END_OF_PART:
                break
            if kind == FORMULA_TEXT and waiting is not None:
                out.append((name, *waiting, _text(body, 0)))
            if kind not in (SHARED_TEXT, NUMBER, RK, MANY_RK, TEXT, TRUTH, FORMULA):
                continue
            waiting = None
            row, col = struct.unpack_from("<HH", body)
            put = lambda c, text: out.append((name, row + 1, column_name(c), text))  # noqa: B023, E731
            if kind == SHARED_TEXT:
                put(col, shared[struct.unpack_from("<I", body, 6)[0]])
            elif kind == NUMBER:
                put(col, _plain(struct.unpack_from("<d", body, 6)[0]))
            elif kind == RK:
                put(col, _plain(_rk(struct.unpack_from("<I", body, 6)[0])))
            elif kind == MANY_RK:
                for k in range((len(body) - 6) // 6):
                    put(col + k, _plain(_rk(struct.unpack_from("<I", body, 4 + 6 * k + 2)[0])))
            elif kind == TEXT:
                put(col, _text(body, 6))
            elif kind == TRUTH and body[7] == 0:
                put(col, "TRUE" if body[6] else "FALSE")
            elif kind == FORMULA:
                if body[12:14] != b"\xff\xff":
                    put(col, _plain(struct.unpack_from("<d", body, 6)[0]))
                elif body[6] == 0:
                    waiting = (row + 1, column_name(col))
                elif body[6] == 1:
                    put(col, "TRUE" if body[8] else "FALSE")
    return out


def compose(sheets: dict[str, list[list]]) -> bytes:
    """A binary workbook of sheets of rows of texts, numbers and None."""
    record = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    begin = lambda part: record(BEGIN, struct.pack("<HHHHII", 0x600, part, 0, 0, 0, 6))
    texts = list(dict.fromkeys(v for rows in sheets.values() for row in rows for v in row if isinstance(v, str)))
    number = {t: i for i, t in enumerate(texts)}

    parts = []
    for rows in sheets.values():
        body = begin(0x10)
        for r, row in enumerate(rows):
            for c, v in enumerate(row):
                if isinstance(v, str):
                    body += record(SHARED_TEXT, struct.pack("<HHHI", r, c, 0, number[v]))
                elif v is not None:
                    body += record(NUMBER, struct.pack("<HHHd", r, c, 0, float(v)))
        parts.append(body + record(END_OF_PART, b""))

    # each text in the record if it fits, else in one of its own that goes on
    strings = [struct.pack("<II", len(texts), len(texts))]
    for t in texts:
        raw = t.encode("utf-16-le", "surrogatepass")
        head = struct.pack("<HB", len(raw) // 2, 1)
        if len(strings[-1]) + len(head) + len(raw) > 8000:
            strings.append(b"")
        room = 7996  # whole characters
        strings[-1] += head + raw[:room]
        for at in range(room, len(raw), 8000):
            strings.append(b"\x01" + raw[at : at + 8000])
    shared = record(SHARED_STRINGS, strings[0]) + b"".join(record(CONTINUE, s) for s in strings[1:])

    def globals_(at: list[int]) -> bytes:
        out = begin(5)
        for name, place in zip(sheets, at, strict=True):
            raw = name.encode("utf-16-le")
            out += record(BOUND_SHEET, struct.pack("<IBBBB", place, 0, 0, len(raw) // 2, 1) + raw)
        return out + shared + record(END_OF_PART, b"")

    first = len(globals_([0] * len(sheets)))
    starts = [first + sum(map(len, parts[:i])) for i in range(len(parts))]
    book = globals_(starts) + b"".join(parts)
    book += b"\0" * max(0, 4096 - len(book))
    n = -(-len(book) // 512)
    tables = 1
    while tables * 128 < tables + 1 + n:
        tables += 1
    if tables > 109:
        raise ValueError("more than 109 sectors of table")
    links = [FAT_SECTOR] * tables + [END] + [tables + 2 + i for i in range(n - 1)] + [END]
    links += [FREE] * (tables * 128 - len(links))
    entry = lambda name, kind, child, start, size: (name + "\0").encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBBIII", 2 * len(name) + 2, kind, 1, FREE, FREE, child) + b"\0" * 36 + struct.pack("<III", start, size, 0)
    directory = (entry("Root Entry", 5, 1, END, 0) + entry("Workbook", 2, FREE, tables + 1, len(book))).ljust(512, b"\0")
    head = MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<9I", 0, tables, tables, 0, 4096, END, 0, END, 0) + struct.pack("<109I", *range(tables), *[FREE] * (109 - tables))
    return head + struct.pack(f"<{len(links)}I", *links) + directory + book.ljust(n * 512, b"\0")


def cells_of(files: DataFrame) -> DataFrame:
    """path, sheet, row, col, text of every cell of binary workbooks given as (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame([(name, *c) for c in cells(bytes(data))], columns=["path", "sheet", "row", "col", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, sheet string, row int, col string, text string")


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    return cells_of(spark.read.format("binaryFile").load(path).select("path", "content"))


def form_amounts(found: DataFrame, header_row: int, total_row: int, planned: list[str], done: list[str], name: str, code: str, deeper: dict[str, str], amount: Column | None = None) -> DataFrame:
    """path, sheet, row, name, function, scope, kind, amount of a printed form's total row and its functional sections.

    planned and done are the columns of the two blocks, whose headings in header_row name the
    scopes and must be the same in both (a form of other headings gives no rows). Sections are rows after
    the total whose code column reads two digits and 00 and whose deeper columns hold the given
    texts; their descendants are left out. amount converts the text; by default exact kopecks.
    """
    from ledgerline.functions.normalise import kopecks

    key = ["path", "sheet"]
    wanted = [*planned, *done]
    heads = found.filter((F.col("row") == header_row) & F.col("col").isin(wanted)).select(*key, "col", F.trim("text").alias("scope"))
    pairs = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(d).alias("d")) for p, d in zip(planned, done, strict=True)))
    both = heads.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("col", "scope"))).alias("h"))  # two blocks of columns
    good = both.filter(F.forall(pairs, lambda x: F.coalesce(F.try_element_at("h", x["p"]) == F.try_element_at("h", x["d"]), F.lit(False))) & (F.size(F.array_distinct(F.transform(pairs, lambda x: F.try_element_at("h", x["p"])))) == len(planned)))
    at = lambda c: F.max(F.when(F.col("col") == c, F.col("text")))
    rows = found.filter(F.col("row") >= total_row).groupBy(*key, "row").agg(at(name).alias("name"), at(code).alias("_code"), *(at(c).alias(f"_{c}") for c in deeper), F.map_from_entries(F.collect_list(F.when(F.col("col").isin(wanted), F.struct("col", "text")))).alias("v"))  # columns of a row
    section = F.col("_code").rlike("^[0-9]{2}00$")
    for c, text in deeper.items():
        section = section & (F.col(f"_{c}") == text)
    kept = rows.filter((F.col("row") == total_row) | section).join(good, key)
    each = kept.select(*key, "row", F.trim("name").alias("name"), F.when(F.col("row") > total_row, F.col("_code")).alias("function"), "v", "h", F.explode(F.concat(F.transform(pairs, lambda x: F.struct(x["p"].alias("c"), F.lit("approved").alias("kind"))), F.transform(pairs, lambda x: F.struct(x["d"].alias("c"), F.lit("executed").alias("kind"))))).alias("x"))
    text = F.try_element_at("v", F.col("x.c"))
    return each.select(*key, "row", "name", "function", F.try_element_at("h", F.col("x.c")).alias("scope"), "x.kind", (kopecks(text) if amount is None else amount).alias("amount"))
