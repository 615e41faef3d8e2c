"""A loopback HTTP server of one file that answers ranges, for readers that need one."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread


@contextmanager
def served(content: bytes) -> Iterator[str]:
    """The address of the content for as long as the block runs."""
    tag = f'"{hashlib.sha256(content).hexdigest()[:16]}"'

    class Handler(BaseHTTPRequestHandler):
        def _head(self, status: int, size: int, *more: tuple[str, str]) -> None:
            self.send_response(status)
            for name, value in (("Content-Length", str(size)), ("ETag", tag), *more):
                self.send_header(name, value)
            self.end_headers()

        def do_HEAD(self) -> None:
            self._head(200, len(content))

        def do_GET(self) -> None:
            asked = re.fullmatch(r"bytes=(\d+)-(\d+)", self.headers.get("Range", ""))
            if self.headers.get("If-Match", tag) != tag:
                self._head(412, 0)
            elif asked is None or int(asked[1]) >= len(content):
                self._head(416, 0)
            else:
                first, last = int(asked[1]), min(int(asked[2]), len(content) - 1)
                self._head(206, last - first + 1, ("Content-Range", f"bytes {first}-{last}/{len(content)}"))
                self.wfile.write(content[first : last + 1])

        def log_message(self, *_) -> None:
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_port}/file"
    finally:
        server.shutdown()
        server.server_close()
