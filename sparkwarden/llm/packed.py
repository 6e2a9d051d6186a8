"""Arrays of integers as compressed bytes, for rows that carry many of them."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_HEAD = struct.Struct("<qq")
_codec = None


def _zstd() -> pa.Codec:
    global _codec
    _codec = _codec or pa.Codec("zstd", compression_level=1)
    return _codec


def pack(x: np.ndarray) -> bytes:
    """x, of integers of any size: its bytes by place (all first bytes, all second ones, ...), compressed. High bytes are mostly zeros."""
    x = np.ascontiguousarray(x)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return _HEAD.pack(len(x), x.itemsize) + (_zstd().compress(planes.tobytes(), asbytes=True) if len(x) else b"")


def unpack(data: bytes, kind: type = np.int64) -> np.ndarray:
    n, size = _HEAD.unpack_from(data)
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(_zstd().decompress(data[_HEAD.size :], n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(np.dtype(f"<u{size}" if np.dtype(kind).kind == "u" else f"<i{size}")).reshape(n).astype(kind, copy=False)


def pack_rising(x: np.ndarray) -> bytes:
    """x, unsigned 64-bit and rising: the steps between its numbers, of which the high bytes are zeros."""
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_rising(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def small(x: np.ndarray) -> np.ndarray:
    """x, not negative, in the smallest unsigned kind that holds it."""
    most = int(x.max(initial=0))
    return x.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max))
