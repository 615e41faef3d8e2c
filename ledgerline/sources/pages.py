"""A paged source: one partition a page, each fetched by the task that reads it."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, offset: int, limit: int):
        super().__init__(offset)
        self.offset, self.limit = offset, limit


def decode(cell: object) -> object:
    """The value of a `__type__payload` envelope whose payload is base64 text; other values as they are."""
    if not (isinstance(cell, str) and cell.startswith("__") and "__" in cell[2:]):
        return cell
    kind, payload = cell[2:].split("__", 1)
    text = base64.b64decode(payload).decode()
    return {"int": int, "double": float}.get(kind, str)(text)


class Pages(DataSource):
    """Options: fetch (`module:function`, called with offset and limit, giving (total, rows)), page, schema.

    The total comes from a first small fetch; a page with another number of rows than it must
    have fails its task, so a source that changes meanwhile is noticed.
    """

    @classmethod
    def name(cls) -> str:
        return "ledgerline_pages"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(self.options)


class PagesReader(DataSourceReader):
    def __init__(self, options):
        self.fetch, self.page = options["fetch"], int(options.get("page", "1000"))

    def _fetch(self, offset: int, limit: int):
        module, function = self.fetch.split(":")
        return getattr(import_module(module), function)(offset, limit)

    def partitions(self) -> list[Page]:
        total, _ = self._fetch(0, 1)
        return [Page(at, min(self.page, total - at)) for at in range(0, total, self.page)]

    def read(self, partition: Page) -> Iterator[tuple]:
        _, rows = self._fetch(partition.offset, partition.limit)
        rows = list(rows)
        if len(rows) != partition.limit:
            raise ValueError(f"page at {partition.offset}: {len(rows)} rows, not {partition.limit}")
        for row in rows:
            yield tuple(decode(c) for c in row)


def numbered(offset: int, limit: int) -> tuple[int, list[tuple]]:
    """A source for tests: 2,500 rows of a number, its square and a typed text."""
    total = 2500
    pack = lambda i: "__string__" + base64.b64encode(f"row {i}".encode()).decode()
    return total, [(i, "__int__" + base64.b64encode(str(i * i).encode()).decode(), pack(i)) for i in range(offset, min(total, offset + limit))]
