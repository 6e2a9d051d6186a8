"""Network messages that survive a crash of the query that reads them.

A receiver writes what comes to a journal before any query sees it: segments of JSON lines that appear in a shared folder at once, whole, and never
change. Spark's file source reads them: its offsets are segments, so a batch that is done again has the same rows, on any number of executors.
Receivers are processes of their own, as many as there are ports or hosts; ``SyslogUdp`` and ``SyslogTcp`` read a port on the driver instead.
"""

from __future__ import annotations

import json
import os
import selectors
import socket
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkwarden.sources.framing import MOST, Framer

SCHEMA = "raw string, collector_peer string, collector_protocol string, ingest_ts double"
LARGEST = 65_535


class Journal:
    """Rows to segments of at most so many rows and seconds. A segment is written under a hidden name, flushed to disk and then renamed."""

    def __init__(self, folder: str, rows: int = 10_000, seconds: float = 1.0):
        os.makedirs(folder, exist_ok=True)
        self.folder, self.rows, self.seconds = folder, rows, seconds
        self.file, self.n, self.began = None, 0, 0.0

    def append(self, raw: str, peer: str, protocol: str) -> None:
        if self.file is None:
            self.name = f"{time.time_ns():020d}-{uuid.uuid4().hex}.json"
            self.file, self.n, self.began = open(f"{self.folder}/.{self.name}", "w", encoding="utf-8"), 0, time.monotonic()  # noqa: SIM115
        self.file.write(json.dumps({"raw": raw, "collector_peer": peer, "collector_protocol": protocol, "ingest_ts": time.time()}) + "\n")
        self.n += 1
        self.roll(self.n >= self.rows)

    def roll(self, now: bool = False) -> None:
        """Ends the segment if it is due, or now."""
        if self.file is None or not (now or time.monotonic() - self.began >= self.seconds):
            return
        self.file.flush()
        os.fsync(self.file.fileno())
        self.file.close()
        os.rename(f"{self.folder}/.{self.name}", f"{self.folder}/{self.name}")
        self.file = None


def receive(journal: Journal, udp: socket.socket | None = None, tcp: socket.socket | None = None, stop: threading.Event | None = None, most: int = MOST) -> None:
    """Writes the datagrams of one socket and the messages of another's connections to the journal, until stop is set. Messages are framed by octet counts or line feeds."""
    ready, framers = selectors.DefaultSelector(), {}
    for s in (udp, tcp):
        if s is not None:
            s.setblocking(False)
            ready.register(s, selectors.EVENT_READ)

    def take(conn: socket.socket) -> None:
        framer, peer = framers[conn]
        try:
            data = conn.recv(1 << 16)
        except OSError:
            data = b""
        for m in framer.feed(data) if data else framer.end():
            journal.append(m.decode("utf-8", "replace"), peer, "tcp")
        if not data or framer.closed:
            ready.unregister(conn)
            conn.close()
            del framers[conn]

    while stop is None or not stop.is_set():
        for key, _ in ready.select(min(0.1, journal.seconds)):
            if key.fileobj is udp:
                data, peer = udp.recvfrom(LARGEST)
                journal.append(data.decode("utf-8", "replace"), peer[0], "udp")
            elif key.fileobj is tcp:
                conn, peer = tcp.accept()
                conn.setblocking(False)
                framers[conn] = Framer(most), peer[0]
                ready.register(conn, selectors.EVENT_READ)
            else:
                take(key.fileobj)
        journal.roll()
    for conn in list(framers):
        conn.close()
    ready.close()
    journal.roll(now=True)


def read(spark: SparkSession, folder: str, segments: int | None = None) -> DataFrame:
    """The journal as a stream of SCHEMA, ``segments`` of it in a micro-batch at most."""
    reader = spark.readStream.schema(SCHEMA)
    return (reader if segments is None else reader.option("maxFilesPerTrigger", segments)).json(folder)
