"""Readers for files that Spark has no reader for, and stated-format ones for those it has.

Office and archive files are read as binary rows and parsed in Arrow batches, one file at a
time, on the executors; nothing is opened by path on the driver.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits for members of archives, in bytes.
MAX_MEMBER, MAX_DEPTH = 1 << 28, 3


#: Encodings that Spark's reader has itself.
BUILT_IN = ("utf-8", "iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32")


def csv(spark: SparkSession, path: str, columns: list[str], sep: str = ";", encoding: str = "windows-1251", header: bool = False) -> DataFrame:
    """All columns as text, so that codes keep their leading zeros; a row with another number of fields fails.

    A single-byte encoding that Spark's reader lacks is read byte for byte and its upper half
    translated; a byte order mark before the first field is dropped.
    """
    built_in = encoding.lower() in BUILT_IN
    schema = ", ".join(f"`{c}` string" for c in columns)
    reader = spark.read.option("sep", sep).option("encoding", encoding if built_in else "iso-8859-1").option("header", str(header).lower()).option("mode", "FAILFAST")
    df = reader.schema(schema).csv(path)
    if not built_in:
        upper = bytes(range(128, 256))
        df = df.select(*(F.translate(c, upper.decode("latin-1"), upper.decode(encoding, errors="replace")).alias(c) for c in columns))
    first = columns[0]
    return df.withColumn(first, F.regexp_replace(first, "^\ufeff", ""))


def series_json(spark: SparkSession, path: str) -> DataFrame:
    """dataset, series_id, series_name, unit, period_label, value of payloads with lookup lists and RawData."""
    schema = "dataset string, headers array<struct<id:int, name:string>>, units array<struct<id:int, name:string>>, RawData array<struct<series:int, unit:int, period:string, value:double>>"
    docs = spark.read.option("multiLine", "true").schema(schema).json(path)
    names, units = F.map_from_entries(F.col("headers")), F.map_from_entries(F.col("units"))
    rows = docs.select("dataset", names.alias("n"), units.alias("u"), F.explode("RawData").alias("r"))
    return rows.select("dataset", F.col("r.series").alias("series_id"), F.try_element_at("n", F.col("r.series")).alias("series_name"), F.try_element_at("u", F.col("r.unit")).alias("unit"), F.col("r.period").alias("period_label"), F.col("r.value").alias("value"))


def day_statuses(spark: SparkSession, path: str) -> DataFrame:
    """key, day, status of lines `key year characters`, one character a day; `valid` is false where the length isn't the year's."""
    parts = F.split(F.col("value"), " ", 3)
    rows = spark.read.text(path).select(parts[0].alias("key"), parts[1].cast("int").alias("year"), parts[2].alias("s"))
    first = F.make_date("year", F.lit(1), F.lit(1))
    days = F.datediff(F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)), first)
    chars = rows.withColumns({"first": first, "valid": F.length("s") == days}).select("key", "first", "valid", F.posexplode(F.split("s", "")).alias("i", "status"))
    return chars.filter("status <> ''").select("key", F.date_add("first", F.col("i")).alias("day"), "status", "valid")


_CELL = re.compile(r"([A-Z]+)([0-9]+)$")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _sheet_cells(data: bytes) -> list[tuple[str, int, str, str | None]]:
    """(sheet, row, column, text) of a workbook: shared and inline strings, numbers, and cached formula values."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter() if _local(t.tag) == "t"))
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            for cell in (c for c in ElementTree.fromstring(z.read(name)).iter() if _local(c.tag) == "c"):
                kind, text = cell.get("t"), None
                for part in cell:
                    if _local(part.tag) == "v":
                        text = part.text
                    elif _local(part.tag) == "is":
                        text = "".join(t.text or "" for t in part.iter() if _local(t.tag) == "t")
                if kind == "s" and text is not None:
                    text = shared[int(text)]
                if at := _CELL.match(cell.get("r", "")):
                    out.append((name.rpartition("/")[2][:-4], int(at[2]), at[1], text))
    return out


def _document_parts(data: bytes) -> list[tuple[str, int, int, int, str]]:
    """(kind, table, row, column, text) of a text document: paragraphs outside tables, and table cells."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if z.testzip() is not None:
            raise ValueError("damaged archive")
        body = next(e for e in ElementTree.fromstring(z.read("word/document.xml")) if _local(e.tag) == "body")
    words = lambda e: "".join(t.text or "" for t in e.iter() if _local(t.tag) == "t")
    tables = paragraphs = 0
    for e in body:
        if _local(e.tag) == "p":
            out.append(("paragraph", -1, paragraphs, 0, words(e)))
            paragraphs += 1
        elif _local(e.tag) == "tbl":
            for r, row in enumerate(x for x in e if _local(x.tag) == "tr"):
                for c, cell in enumerate(x for x in row if _local(x.tag) == "tc"):
                    out.append(("cell", tables, r, c, words(cell)))
            tables += 1
    return out


def _members(data: bytes, prefix: str = "", depth: int = 0) -> list[tuple[str, int, str, str | None]]:
    """(member, bytes, status, reason), archives within archives too; a member that can't be trusted is quarantined, not read."""
    out = []
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return [(prefix or ".", len(data), "quarantined", "not an archive")]
    with z:
        for info in z.infolist():
            if info.is_dir():
                continue
            name, reason, inner = prefix + info.filename, None, b""
            if info.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", info.filename) or ":" in info.filename:
                reason = "unsafe path"
            elif info.flag_bits & 1:
                reason = "encrypted"
            elif info.file_size > MAX_MEMBER:
                reason = "too large"
            else:
                try:
                    inner = z.read(info)
                except (zipfile.BadZipFile, NotImplementedError, EOFError):
                    reason = "damaged"
            out.append((name, info.file_size, "quarantined" if reason else "ok", reason))
            if reason is None and name.lower().endswith(".zip"):
                out += _members(inner, name + "!", depth + 1) if depth < MAX_DEPTH else [(name + "!", len(inner), "quarantined", "nested too deeply")]
    return out


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _parsed(files: DataFrame, parse, schema: str, columns: list[str]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame([(name, *row) for row in parse(bytes(data))], columns=["path", *columns])

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}")


def cells_of(files: DataFrame) -> DataFrame:
    """path, sheet, row, col, text of every cell of workbooks given as (path, content)."""
    return _parsed(files, _sheet_cells, "sheet string, row int, col string, text string", ["sheet", "row", "col", "text"])


def parts_of(files: DataFrame) -> DataFrame:
    """path, kind, table, row, col, text of paragraphs and table cells of text documents given as (path, content)."""
    return _parsed(files, _document_parts, "kind string, table int, row int, col int, text string", ["kind", "table", "row", "col", "text"])


def members_of(files: DataFrame) -> DataFrame:
    """path, member, bytes, status, reason of the members of archives given as (path, content)."""
    return _parsed(files, _members, "member string, bytes long, status string, reason string", ["member", "bytes", "status", "reason"])


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    return cells_of(_binary(spark, path))


def document_parts(spark: SparkSession, path: str) -> DataFrame:
    return parts_of(_binary(spark, path))


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    return members_of(_binary(spark, path))
