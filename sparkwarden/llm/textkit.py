"""Vectorised work on the UTF-8 bytes of Arrow string columns: words, hashes and runs.

All functions take whole texts. A slice of about SLICE bytes is worked on at a time, and a longer
text is a slice of its own, so memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words: all but white space; or ASCII letters and digits and all beyond ASCII.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_powers = np.ones(1, U), np.ones(1, U)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, SLICE + 1)
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(n, base, U)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers = tables[0], tables[1]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Texts:
    """Some texts end to end. data: their bytes; bounds: where each begins, and the end; at: their rows in the batch."""

    data: np.ndarray
    bounds: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.bounds) - 1


def slices(column: pa.Array) -> Iterator[Texts]:
    """The column's texts in order, null as empty, about SLICE bytes at a time."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLICE, "right")) - 1)
        yield Texts(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], i)
        i = j


@dataclass
class Words:
    """Words of some texts. start, end: bytes; of: number of words before each text's first, and in all."""

    start: np.ndarray
    end: np.ndarray
    of: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.of)


def words(texts: Texts, kind: np.ndarray, data: np.ndarray | None = None) -> Words:
    """Runs of bytes of the kind; none reaches over a text's end."""
    inside = kind[texts.data if data is None else data]
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[texts.bounds] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    return Words(start, end, np.searchsorted(start, texts.bounds))


def word_hashes(data: np.ndarray, w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[w.end] - sums[w.start]) * down[w.start] + (w.end - w.start).astype(U))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive of h."""
    n = max(0, len(h) - k + 1)
    out = h[:n].copy()
    for j in range(1, k):
        out = mix(out * U(0xD1342543DE82EF95) + h[j : j + n])
    return out


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column out of values end to end."""
    bounds = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
