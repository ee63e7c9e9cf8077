"""Compact binary columns: byte planes of integer arrays under zstd, so that sorted or small numbers take few bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", 1)


def pack(a: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + (_CODEC.compress(raw, asbytes=True) if raw else b"")


def unpack(data: bytes, dtype) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.empty(0, dtype)
    raw = np.frombuffer(_CODEC.decompress(data[8:], n), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n // width).T).view(dtype).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending unsigned numbers as differences."""
    return pack(np.diff(a, prepend=np.zeros(1, a.dtype)))


def unpack_sorted(data: bytes, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


def range_cuts(h: np.ndarray, ranges: int) -> np.ndarray:
    """Where ascending 64-bit hashes pass from one of the equal ranges to the next: ranges + 1 positions."""
    edges = (np.arange(1, ranges, dtype=np.float64) * (2.0**64 / ranges)).astype(np.uint64)
    return np.concatenate(([0], np.searchsorted(h, edges), [len(h)]))
