"""Vectorised words and rolling hashes over Arrow text columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D in the UTF-8 text, which equals the
regular expression ``[^\\x20\\x09-\\x0D]+`` on code points, as none of those bytes occurs inside a
multi-byte code point. Hashes are 64-bit polynomial hashes of the whole word with an odd base and
random byte values, then mixed; two given different words collide with a probability of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
WS = np.zeros(256, bool)
WS[[0x20, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
BYTE[WS] = 0
ANY = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
BASE = U64(0x9E3779B97F4A7C15)
INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_pow: dict[str, np.ndarray] = {"p": np.ones(1, U64), "q": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_pow["p"]) < n:
        m = max(n, 1 << 16)
        for key, base in (("p", BASE), ("q", INV)):
            a = np.full(m, base, U64)
            a[0] = 1
            _pow[key] = np.cumprod(a, dtype=U64)
    return _pow["p"][:n], _pow["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(29))
    h = h * U64(0xA0761D6478BD642F)
    return h ^ (h >> U64(32))


class Words:
    """Words of several documents: byte positions in ``buf`` and, for each document, its range of words."""

    __slots__ = ("bounds", "buf", "data", "ends", "starts")

    def __init__(self, docs: list[bytes], between: np.ndarray = WS):
        """between: which bytes separate words; the space must."""
        self.data = b" " + b" ".join(docs) + b" "
        self.buf = np.frombuffer(self.data, np.uint8)
        solid = (~between[self.buf]).view(np.int8)
        edge = np.diff(solid)
        self.starts = np.flatnonzero(edge == 1) + 1
        self.ends = np.flatnonzero(edge == -1) + 1
        at = np.cumsum(np.fromiter((len(d) + 1 for d in docs), np.int64, len(docs))) + 1
        self.bounds = np.concatenate(([0], np.searchsorted(self.starts, at)))

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def hashes(self, lower: bool = False) -> np.ndarray:
        p, q = powers(len(self.buf) + 1)
        total = np.empty(len(self.buf) + 1, U64)
        total[0] = 0
        np.cumsum((BYTE_LOWER if lower else BYTE)[self.buf] * p[:-1], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * q[self.starts] + (self.ends - self.starts).astype(U64))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of every window of k consecutive values; the caller masks those that cross documents."""
    if len(h) < k:
        return np.empty(0, U64)
    p, q = powers(len(h) + 1)
    total = np.empty(len(h) + 1, U64)
    total[0] = 0
    np.cumsum(h * p[:-1], out=total[1:])
    return mix((total[k:] - total[:-k]) * q[: len(h) - k + 1])


def inside(bounds: np.ndarray, k: int) -> np.ndarray:
    """Starts of the windows of k words that stay within one document."""
    n = int(bounds[-1])
    if n < k:
        return np.empty(0, np.int64)
    ok = np.zeros(n + 1, np.int32)
    lo, hi = bounds[:-1], bounds[1:] - k + 1
    keep = hi > lo
    np.add.at(ok, lo[keep], 1)
    np.add.at(ok, hi[keep], -1)
    return np.flatnonzero(np.cumsum(ok[:-1]))


def cover(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Of n words, those in a window of k words that begins at one of the starts."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + k, -1)
    return np.cumsum(d[:-1]) > 0


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def slices(sizes, most: int) -> Iterator[slice]:
    """Consecutive slices of about ``most`` bytes; at least one document each."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def prefix_sums(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums over all bytes, and the inverse powers that make spans comparable; see ``span``."""
    p, q = powers(len(buf) + 1)
    total = np.empty(len(buf) + 1, U64)
    total[0] = 0
    np.cumsum(ANY[buf] * p[:-1], out=total[1:])
    return total, q


def span(total: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings [a, b)."""
    return mix((total[b] - total[a]) * q[a] + (b - a).astype(U64))
