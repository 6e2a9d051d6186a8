"""Syslog datagrams as a streaming source: ``spark.dataSource.register(SyslogUdp)``, then ``readStream.format("syslog_udp")``."""

from __future__ import annotations

import selectors
import socket
import time

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from sparkwarden.sources.framing import Framer

LARGEST = 65_535


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.address, self.wait = (options.get("host", "0.0.0.0"), int(options.get("port", 5514))), float(options.get("wait", 0.2))
        self.most, self.kept, self.sock = int(options.get("max_rows", 10_000)), {}, None

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict):
        rows = []
        if self.sock is None:  # Spark makes readers that never read; only one may hold the port
            self.sock = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.sock.bind(self.address)
            self.sock.settimeout(self.wait)
        while len(rows) < self.most:
            try:
                data, peer = self.sock.recvfrom(LARGEST)
            except (TimeoutError, OSError):
                break
            rows.append((data.decode("utf-8", "replace"), peer[0], "udp", time.time()))
        end = start["n"] + len(rows)
        self.kept[start["n"]] = rows
        return iter(rows), {"n": end}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self.kept.get(start["n"], []))

    def commit(self, end: dict) -> None:
        self.kept = {k: v for k, v in self.kept.items() if k >= end["n"]}


class _TcpReader(_Reader):
    """Takes what connections have sent so far; a connection's bytes are framed in order, whatever batches they come in."""

    def read(self, start: dict):
        if self.sock is None:
            self.sock = socket.create_server(self.address, reuse_port=False)
            self.sock.setblocking(False)
            self.ready, self.framers = selectors.DefaultSelector(), {}
            self.ready.register(self.sock, selectors.EVENT_READ)
        rows = []
        while len(rows) < self.most and (events := self.ready.select(self.wait)):
            for key, _ in events:
                rows += self._accept() if key.fileobj is self.sock else self._receive(key.fileobj)
        end = start["n"] + len(rows)
        self.kept[start["n"]] = rows
        return iter(rows), {"n": end}

    def _accept(self) -> list:
        conn, peer = self.sock.accept()
        conn.setblocking(False)
        self.ready.register(conn, selectors.EVENT_READ)
        self.framers[conn] = Framer(), peer[0]
        return []

    def _receive(self, conn) -> list:
        framer, peer = self.framers[conn]
        try:
            data = conn.recv(1 << 16)
        except OSError:
            data = b""
        messages = list(framer.feed(data)) if data else list(framer.end())
        if not data or framer.closed:
            self.ready.unregister(conn)
            conn.close()
            del self.framers[conn]
        return [(m.decode("utf-8", "replace"), peer, "tcp", time.time()) for m in messages]


class SyslogTcp(DataSource):
    """As ``SyslogUdp``, for messages over TCP connections, framed by octet counts or line feeds; the port is read on the driver, for sites without a collector."""

    @classmethod
    def name(cls) -> str:
        return "syslog_tcp"

    def schema(self) -> str:
        return "raw string, collector_peer string, collector_protocol string, ingest_ts double"

    def simpleStreamReader(self, schema):
        return _TcpReader(dict(self.options))


class SyslogUdp(DataSource):
    """(raw, collector_peer, collector_protocol, ingest_ts): a row for each datagram, options host, port, wait and max_rows. Datagrams that no batch has taken are lost with the driver, as UDP is."""

    @classmethod
    def name(cls) -> str:
        return "syslog_udp"

    def schema(self) -> str:
        return "raw string, collector_peer string, collector_protocol string, ingest_ts double"

    def simpleStreamReader(self, schema):
        return _Reader(dict(self.options))
