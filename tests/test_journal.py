"""A receiver's journal: what came is read once, also by queries that die between reading and committing."""

import os
import socket
import threading
import time

import pytest

from sparkwarden.sources import journal


def sent(folder, tmp=0.05):
    udp = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    udp.bind(("127.0.0.1", 0))
    tcp = socket.create_server(("127.0.0.1", 0))
    stop = threading.Event()
    worker = threading.Thread(target=journal.receive, args=(journal.Journal(folder, rows=7, seconds=tmp), udp, tcp, stop))
    worker.start()
    return udp, tcp, stop, worker


def rows_in(folder):
    return sum(len(open(f"{folder}/{f}").readlines()) for f in os.listdir(folder) if not f.startswith("."))


def test_nothing_is_lost_or_repeated(spark, tmp_path):
    folder = str(tmp_path / "journal")
    udp, tcp, stop, worker = sent(folder)
    out, ports = socket.socket(socket.AF_INET, socket.SOCK_DGRAM), (udp.getsockname(), tcp.getsockname())
    for k in range(40):
        out.sendto(f"datagram {k} é".encode(), ports[0])
        time.sleep(0.001)
    conn = socket.create_connection(ports[1])
    for k in range(40):
        message = f"message {k}"
        conn.sendall((f"{len(message)} {message}" if k % 2 else f"{message}\n").encode())
    conn.sendall(b"no end")
    conn.close()
    end = time.monotonic() + 20
    while rows_in(folder) < 81 and time.monotonic() < end:
        time.sleep(0.05)
    want = sorted([f"datagram {k} é" for k in range(40)] + [f"message {k}" for k in range(40)] + ["no end"])
    taken, fail = {}, [True]

    def sink(batch, number):
        got = [r.raw for r in batch.collect()]
        if number == 2 and fail[0]:
            raise RuntimeError("died before the commit")
        assert number not in taken or sorted(taken[number]) == sorted(got)
        taken[number] = got

    def run():
        q = journal.read(spark, folder, 2).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="died before the commit"):
        run()
    fail[0] = False
    run()
    assert sorted(sum(taken.values(), [])) == want and len(taken) > 3
    for k in range(5):
        out.sendto(f"later {k}".encode(), ports[0])
    end = time.monotonic() + 20
    while rows_in(folder) < 86 and time.monotonic() < end:
        time.sleep(0.05)
    stop.set()
    worker.join()
    run()  # what came while no query ran
    assert sorted(sum(taken.values(), [])) == sorted([*want, *(f"later {k}" for k in range(5))])


def test_segments_appear_whole(tmp_path):
    j = journal.Journal(str(tmp_path), rows=3, seconds=60)
    for k in range(7):
        j.append(f"m{k}", "p", "udp")
    names = sorted(os.listdir(tmp_path))
    assert sum(not n.startswith(".") for n in names) == 2 and sum(n.startswith(".") for n in names) == 1
    j.roll()
    assert sum(not n.startswith(".") for n in os.listdir(tmp_path)) == 2
    j.roll(now=True)
    assert rows_in(tmp_path) == 7 and not any(n.startswith(".") for n in os.listdir(tmp_path))
