"""Members of archives behind HTTP, read by ranges: the archive is never fetched whole.

The size and the entity tag are pinned when a reader is opened; an answer of another size or
tag, or one that isn't exactly the range, is an error.
"""

from __future__ import annotations

import io
import re
import time
import zipfile
from collections.abc import Iterator
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes asked for at once at least, and at most.
AHEAD, LARGEST = 1 << 20, 1 << 23


class RangeFile(io.RawIOBase):
    """A seekable file over ranges of one URL; `requests` and `fetched` count what it cost."""

    def __init__(self, url: str, timeout: float = 60, attempts: int = 4, pause: float = 1.0):
        super().__init__()
        self.url, self.timeout, self.attempts, self.pause = url, timeout, attempts, pause
        with urlopen(Request(url, method="HEAD"), timeout=timeout) as answer:
            if answer.url != url:
                raise ValueError("redirected")
            self.size, self.tag = int(answer.headers["Content-Length"]), answer.headers["ETag"]
        self.place, self.requests, self.fetched = 0, 0, 0
        self._from, self._held = 0, b""

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.place

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        start = {io.SEEK_SET: 0, io.SEEK_CUR: self.place, io.SEEK_END: self.size}[whence]
        if start + offset < 0:
            raise ValueError("before the start")
        self.place = start + offset
        return self.place

    def _fetch(self, first: int, last: int) -> bytes:
        headers = {"Range": f"bytes={first}-{last}"} | ({"If-Match": self.tag} if self.tag else {})
        for turn in range(self.attempts):
            try:
                with urlopen(Request(self.url, headers=headers), timeout=self.timeout) as answer:
                    body, said = answer.read(), answer.headers.get("Content-Range", "")
                    if answer.status != 206 or re.fullmatch(r"bytes (\d+)-(\d+)/(\d+)", said) is None or said != f"bytes {first}-{last}/{self.size}":
                        raise ValueError("not the range that was asked for")
                    if answer.headers["ETag"] != self.tag:
                        raise ValueError("the file has changed")
                break
            except HTTPError as e:
                if e.code == 412:
                    raise ValueError("the file has changed") from e
                if e.code < 500 or turn == self.attempts - 1:
                    raise
            except (URLError, TimeoutError, ConnectionError):
                if turn == self.attempts - 1:
                    raise
            time.sleep(self.pause * 2**turn)
        if len(body) != last - first + 1:
            raise ValueError("cut short")
        self.requests += 1
        self.fetched += len(body)
        return body

    def readinto(self, buffer) -> int:
        n = max(0, min(len(buffer), self.size - self.place, LARGEST))
        if n and not (self._from <= self.place and self.place + n <= self._from + len(self._held)):
            self._from = self.place
            self._held = self._fetch(self.place, min(self.size, self.place + max(n, AHEAD)) - 1)
        at = self.place - self._from
        buffer[:n] = self._held[at : at + n]
        self.place += n
        return n


def open_archive(url: str, **how) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BufferedReader(RangeFile(url, **how), 1 << 16))


def members(archives: DataFrame, pattern: str = ".*", contents: bool = True) -> DataFrame:
    """url, member, bytes, crc, content of the members that match, of the archives at url; each archive in one task, and of it only what is asked for."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for url in frame["url"]:
                with open_archive(url) as archive:
                    for info in archive.infolist():
                        if not info.is_dir() and re.fullmatch(pattern, info.filename):
                            yield pd.DataFrame([(url, info.filename, info.file_size, info.CRC, archive.read(info) if contents else None)], columns=["url", "member", "bytes", "crc", "content"])

    return archives.select(F.col("url")).mapInPandas(run, "url string, member string, bytes long, crc long, content binary")
