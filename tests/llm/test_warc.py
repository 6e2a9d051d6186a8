import hashlib

import pytest

from sparkwarden.llm import warc
from sparkwarden.llm.warc import parse_record, read_archives, round_trip, segments, write_archives

TRAP = "\r\n\r\nWARC/1.1\r\n"


def brute(rows):
    last = {}
    for i, _, h in rows:
        if i is not None and h and len(h.encode()) >= 1000:
            last[h] = max(i, last.get(h, i))
    out = []
    for i, _, h in rows:
        p, ref = (h or "").encode(), last.get(h, i) if i is not None else None
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if ref == i else "revisit", None if ref == i else ref))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/", "x" * 1000), (9, "http://b/\r\nX: y", "x" * 1000), (5, None, "x" * 1000), (2, "u", "x" * 999), (3, "u", "x" * 999), (4, "u", None), (6, "", ""), (7, "u", "é" * 5001), (8, "u", "中\U0001f600" * 3000),
    (10, "u", "a" + TRAP + "b"), (11, "u", TRAP), (12, "u", TRAP[:-2]), (13, "u", TRAP * 200), (14, "u", "z\r\n\r\n"), (15, "u", "\r\n"), (16, "u", "\r\n\r\nWARC"), (17, "u", "\r\n\r\nWA" * 5), (18, "u", "\r\n" * 4001), (None, "u", "n" * 2000), (None, "u", "n" * 2000), (8, "u", "中\U0001f600" * 3000), (21, "u", "\x00\r\n" * 9), (19, "u", "q" * 300_000),
]


@pytest.mark.parametrize("chunk", [64, 1 << 16])
def test_round_trip(spark, chunk):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string")
    assert sorted(map(tuple, round_trip(df, chunk).collect()), key=str) == brute(ROWS)


def test_copies_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "FEW", -1)
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    assert sorted(map(tuple, round_trip(df).collect()), key=str) == brute(ROWS)


def test_split_files(spark, tmp_path):
    rows = [(i, "u", ("%d\r\n\r\nWARC" % i) * 300) for i in range(200)]
    write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"), 500)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10007")
    try:
        assert sorted(map(tuple, read_archives(spark, str(tmp_path / "w")).collect()), key=str) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty(spark):
    assert round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_segments():
    p = ("é" * 10 + TRAP).encode()
    assert b"".join(segments(p, 5)) == p and all(len(s) <= 5 and bytes(s).decode() is not None for s in segments(p, 5)) and segments(b"") == [b""]
    assert parse_record(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n") == ({"content-length": "2"}, b"ab")


@pytest.mark.parametrize("chunk", [9, 64, 1 << 16])
def test_payloads_that_start_like_a_record(spark, chunk):
    starts = ["WARC/1.1\r\n", "WARC/1.1", "\r\nWARC/1.1\r\nx", "\r\nWARC/1.1", "WARC/1.1\r\n" * 40, "\r\nWARC/1.1" * 40, "x" * 64 + "WARC/1.1\r\ny", "x" * 64 + "\r\nWARC/1.1\r\ny", "WARC/1.1\r\n" + "z" * 70_000]
    rows = [(i, "u", h) for i, h in enumerate(starts)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(map(tuple, round_trip(df, chunk).collect()), key=str) == brute(rows)
