"""A Bloom filter of fixed size over ids, built in Spark; it only saves shuffling, results never depend on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean

BITS = 1 << 23
CHUNK = 1 << 16  # bytes of the bit table to a row


def _places(ids: np.ndarray) -> list[np.ndarray]:
    from .textnp import mix

    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    return [(h & np.uint64(BITS - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(BITS - 1)).astype(np.int64)]


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(BITS, bool)
    for b in batches:
        for at in _places(b.column(0).to_numpy(zero_copy_only=False)):
            bits[at] = True
    if bits.any():
        rows = np.packbits(bits).reshape(-1, CHUNK)
        some = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([rows[i].tobytes() for i in some])], names=["chunk", "bits"])


def _merge(chunk):
    out = np.zeros(CHUNK, np.uint8)
    for x in chunk["bits"]:
        out |= np.frombuffer(x, np.uint8)
    return chunk.iloc[:1].assign(bits=[out.tobytes()])


def build(ids: DataFrame) -> np.ndarray:
    """BITS / 8 bytes, whatever the number of ids (one long column without nulls)."""
    table = np.zeros((BITS // 8 // CHUNK, CHUNK), np.uint8)
    for r in ids.mapInArrow(lean(_tables), "chunk int, bits binary").groupBy("chunk").applyInPandas(_merge, "chunk int, bits binary").collect():
        table[r.chunk] = np.frombuffer(r.bits, np.uint8)
    return table.ravel()


def maybe(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    found = np.ones(len(ids), bool)
    for at in _places(ids):
        found &= (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return found
