"""Orders that a seed and a name decide, the same on every run and platform."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Offset and prime of 32-bit FNV-1a, and the increment of the generator mulberry32 (both public domain).
FNV_OFFSET, FNV_PRIME, STEP = 0x811C9DC5, 0x01000193, 0x6D2B79F5
_M = 0xFFFFFFFF


def fnv1a32(text: str) -> int:
    """FNV-1a over UTF-16 code units."""
    h = FNV_OFFSET
    raw = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(raw), 2):
        h = (h ^ int.from_bytes(raw[i : i + 2], "little")) * FNV_PRIME & _M
    return h


def uniform(seed: int) -> Iterator[float]:
    """Numbers from 0 to 1 of mulberry32."""
    state = seed & _M
    while True:
        state = (state + STEP) & _M
        x = (state ^ state >> 15) * (state | 1) & _M
        x ^= (x + (x ^ x >> 7) * (x | 61)) & _M
        yield ((x ^ x >> 14) & _M) / 2**32


def shuffled(items: list, seed: int) -> list:
    """Fisher-Yates from the end."""
    out, draw = list(items), uniform(seed)
    for last in range(len(out) - 1, 0, -1):
        pick = int(next(draw) * (last + 1))
        out[last], out[pick] = out[pick], out[last]
    return out


def sample(findings: DataFrame, n: int, seed: int, slug: str) -> DataFrame:
    """The first n ids of each kind in the order that ``seed:slug:kind`` gives to the ids sorted; kind, id, turn.

    Only ids travel, and the ids of one kind meet in one task, as their order depends on all of them.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        kind = group["kind"].iloc[0]
        ids = shuffled(sorted(group["id"], key=lambda s: s.encode("utf-16-be", "surrogatepass")), fnv1a32(f"{seed}:{slug}:{kind}"))[:n]
        return pd.DataFrame({"kind": kind, "id": ids, "turn": range(1, len(ids) + 1)})

    return findings.select("kind", "id").groupBy("kind").applyInPandas(run, "kind string, id string, turn int")
