"""Messages out of the bytes of TCP connections: octet counts or line feeds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Bytes of a message at most, and digits of its count.
MOST, DIGITS = 1 << 20, 20


class Framer:
    """Takes a connection's bytes as they come, gives messages. An oversized message ends the connection. Each byte is looked at a fixed number of times."""

    def __init__(self, most: int = MOST):
        self.most, self.held, self.at, self.seen, self.closed = most, bytearray(), 0, 0, False

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.held += data
        while self.at < len(self.held) and not self.closed:
            size, body = self._count()
            if size is not None:
                if size > self.most:
                    self.closed = True
                elif len(self.held) >= body + size:
                    yield self._take(body, body + size)
                    continue
                break
            line = self.held.find(b"\n", max(self.at, self.seen))
            if line < 0:
                self.seen = len(self.held)
                rest = len(self.held) - self.at
                self.closed = rest > self.most and not self.held[self.at : self.at + DIGITS].isdigit()
                break
            if line - self.at > self.most:
                self.closed = True
                break
            message = self._take(self.at, line)
            self.at += 1
            yield message
        del self.held[: self.at]
        self.seen, self.at = max(0, self.seen - self.at), 0

    def _count(self) -> tuple[int | None, int]:
        """The count that stands before the first space, and where the message begins."""
        space = self.held.find(b" ", self.at, self.at + DIGITS + 1)
        head = self.held[self.at : space] if space > self.at else b""
        return (int(head), space + 1) if head.isdigit() else (None, 0)

    def _take(self, start: int, end: int) -> bytes:
        self.at = end
        return bytes(self.held[start:end])

    def end(self) -> Iterator[bytes]:
        """A last line without its line feed; an incomplete counted message is lost."""
        if self.held and not self.closed and self._count()[0] is None:
            yield bytes(self.held)


def deframe(chunks: DataFrame, most: int = MOST) -> DataFrame:
    """(conn, n, raw) of chunks (conn, seq, data): each connection's messages in order, as UTF-8 with replacements. A connection's bytes go through one task in order, a batch at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, framer, n = None, None, 0

        def rows(messages):
            nonlocal n
            out = []
            for m in messages:
                out.append((at, n, m.decode("utf-8", "replace")))
                n += 1
            return out

        for frame in frames:
            out = []
            for conn, data in zip(frame["conn"], frame["data"], strict=True):
                if conn != at:
                    if framer:
                        out += rows(framer.end())
                    at, framer, n = conn, Framer(most), 0
                out += rows(framer.feed(bytes(data)))
            yield pd.DataFrame(out, columns=["conn", "n", "raw"])
        if framer:
            yield pd.DataFrame(rows(framer.end()), columns=["conn", "n", "raw"])

    sent = chunks.select("conn", "seq", "data").repartition("conn").sortWithinPartitions("conn", "seq")
    return sent.mapInPandas(run, "conn string, n long, raw string")
