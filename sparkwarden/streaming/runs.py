"""Rows of a key in order of a number, however many there are: sorted runs lie on the worker's own disk and are merged block by block."""

from __future__ import annotations

import os
import random
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of rows that are sorted at once; rows of a block that is read again, and of a piece that is given out; runs that are merged at once.
RUN, BLOCK, PIECE, FAN = 16 << 20, 256, 4_096, 128
_LAST = np.iinfo(np.int64).max


def _numbers(t: pa.Table | pa.RecordBatch, by: str) -> np.ndarray:
    """The column's values, nulls at the end."""
    return t.column(by).fill_null(_LAST).to_numpy().astype(np.int64, copy=False)


def _sorted(tables: list[pa.Table], by: str) -> pa.Table:
    t = pa.concat_tables(tables)
    numbers = _numbers(t, by)
    return t if (numbers[1:] >= numbers[:-1]).all() else t.take(pa.array(np.argsort(numbers, kind="stable")))


def _write(tables: Iterable[pa.Table], schema: pa.Schema, path: str) -> str:
    with pa.OSFile(path, "wb") as f, pa.ipc.new_stream(f, schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        for t in tables:
            out.write_table(t, max_chunksize=BLOCK)
    return path


class _Run:
    """What is left of a run's present block."""

    def __init__(self, path: str, by: str):
        self.file, self.by, self.block = pa.OSFile(path, "rb"), by, None
        self.batches = iter(pa.ipc.open_stream(self.file))
        self.fill()

    def fill(self) -> None:
        while self.block is None or not self.block.num_rows:
            self.block = next(self.batches, None)
            if self.block is None:
                self.file.close()
                return
            self.numbers = _numbers(self.block, self.by)

    def upto(self, bound: int) -> pa.RecordBatch:
        n = int(np.searchsorted(self.numbers, bound, side="right"))
        out, self.block, self.numbers = self.block.slice(0, n), self.block.slice(n), self.numbers[n:]
        self.fill()
        return out


def _merged(paths: list[str], by: str) -> Iterator[pa.Table]:
    """What all runs hold up to the least last number of their blocks, again and again."""
    runs = [r for r in (_Run(p, by) for p in paths) if r.block is not None]
    while runs:
        bound = min(r.numbers[-1] for r in runs)
        yield _sorted([pa.Table.from_batches([r.upto(bound)]) for r in runs if r.numbers[0] <= bound], by)
        runs = [r for r in runs if r.block is not None]


def _pieces(tables: Iterable[pa.Table]) -> Iterator[pa.Table]:
    held, n = [], 0
    for t in tables:
        held.append(t)
        n += len(t)
        if n >= PIECE:
            whole = pa.concat_tables(held)
            yield from (whole.slice(i, PIECE) for i in range(0, n - n % PIECE, PIECE))
            held, n = [whole.slice(n - n % PIECE)], n % PIECE
    if n:
        yield pa.concat_tables(held)


def in_order(tables: Iterable[pa.Table], by: str) -> Iterator[pa.Table]:
    """The rows by a column of whole numbers, nulls last, in pieces of PIECE rows. Memory holds one run and a block of each of FAN others; more than a run goes to disk."""
    tables = iter(tables)
    held, size, paths = [], 0, []
    local = random.choice((os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()).split(","))
    with tempfile.TemporaryDirectory(prefix="runs-", dir=local) as folder:
        for t in tables:
            if size >= RUN:
                paths.append(_write([_sorted(held, by)], t.schema, f"{folder}/{len(paths)}"))
                held, size = [], 0
            held.append(t)
            size += t.nbytes
        if not held:
            return
        last, schema = _sorted(held, by), held[0].schema
        del held
        if not paths:
            yield from _pieces([last])
            return
        paths.append(_write([last], schema, f"{folder}/{len(paths)}"))
        del last
        made = len(paths)
        while len(paths) > FAN:
            first, paths = paths[:FAN], paths[FAN:]
            paths.append(_write(_merged(first, by), schema, f"{folder}/{made}"))
            made += 1
            for p in first:
                os.remove(p)
        yield from _pieces(_merged(paths, by))
