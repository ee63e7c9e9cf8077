"""Embedding near-dedup by spherical-cap filters from structured random product codes.

Vectors are scaled to length one and turned by a random rotation. A filter direction is a pair of code words,
one from a random code for either half of the space, so that a vector finds all filters above the cap
height (list decoding) from two short score lists. Vectors meet under their filters, and cosines are
verified there in double precision. The cap height follows from the number of vectors: as many
filters as give similar vectors EXPECTED common ones, with about RANDOM chance meetings for a vector.

A pair is counted under its smallest common filter only, as numbers per vector, and its link goes into a
spanning forest: no pair of vectors is ever a row. Equal vectors are one weighted vector. Filters with
more than BLOCK vectors are cut into blocks that meet two by two.

Any finite magnitude will do: very large and very small doubles are scaled first. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so do vectors
of different dimensions. Every row is a vector: rows with the same id and vector link to each other
in n_links. An empty table gives no rows. Labels and other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .common import cut, lean, shuffle_partitions, table
from .jaccard_join import forest

COSINE = 0.9
EXPECTED, RANDOM = 10.0, 8.0
MOST_CODE = 4096
BLOCK = 2048
SEED = 20240611


@lru_cache(maxsize=None)
def _marginal(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid, and probability that one coordinate of a random unit vector of that dimension reaches each point."""
    t = np.linspace(-1, 1, 20001)
    f = np.exp((dim - 3) / 2 * np.log(np.maximum(1 - t * t, 1e-300)))
    upper = np.cumsum(f[::-1])[::-1]
    return t, upper / upper[0]


def _tail(height: float, dim: int) -> float:
    return float(np.interp(height, *_marginal(dim)))


def _both(height: float, dim: int, rho: float) -> float:
    """Probability that a random direction is within the cap of two unit vectors of cosine rho."""
    t = np.linspace(height, 1 - 1e-9, 2000)
    f = np.exp((dim - 3) / 2 * np.log(1 - t * t))
    grid, _ = _marginal(dim)
    f /= np.exp((dim - 3) / 2 * np.log(np.maximum(1 - grid * grid, 1e-300))).sum() * (grid[1] - grid[0])
    given = np.interp((height - rho * t) / (math.sqrt(1 - rho * rho) * np.sqrt(1 - t * t)), *_marginal(dim - 1))
    return float((f * given).sum() * (t[1] - t[0]))


def cap(n: int, dim: int, cosine: float = COSINE) -> tuple[float, int]:
    """(cap height, code words for each half) for n vectors; very low dimensions have one cap, the whole sphere."""
    if dim < 4:
        return -2.0, 1
    height = 0.0
    while True:
        p, q = _tail(height, dim), _both(height, dim, cosine)
        code = math.ceil(math.sqrt(EXPECTED / q))
        if n * code * code * p * p <= RANDOM or code >= MOST_CODE:
            return height, code
        height += 0.01


class Codes:
    def __init__(self, dim: int, height: float, words: int):
        r = np.random.default_rng(SEED + dim)
        self.turn = np.linalg.qr(r.standard_normal((dim, dim)))[0]
        self.half = (dim + 1) // 2
        a, b = (r.standard_normal((words, k)) for k in (self.half, dim - self.half))
        unit = lambda x, k: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30) * math.sqrt(k / dim)
        self.a, self.b = unit(a, self.half), unit(b, dim - self.half)
        self.height, self.words, self.dim = height, words, dim

    def filters(self, x: np.ndarray) -> list[np.ndarray]:
        """For unit rows, the numbers of all filters above the cap height."""
        y = x @ self.turn
        s, t = y[:, : self.half] @ self.a.T, y[:, self.half :] @ self.b.T
        out = []
        for u, v in zip(s, t):
            i, j = np.flatnonzero(u >= self.height - v.max()), np.flatnonzero(v >= self.height - u.max())
            p, q = np.nonzero(u[i][:, None] + v[j][None, :] >= self.height)
            out.append((i[p] * self.words + j[q]).astype(np.int32))
        return out


def unit(rows) -> np.ndarray:
    x = np.stack(rows).astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _filters(n: int, cosine: float):
    codes: dict[int, Codes] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [np.array(v) for v in b.column("v").to_pylist()]
            found: list = [None] * len(vectors)
            for dim in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == dim]
                if dim not in codes:
                    codes[dim] = Codes(dim, *cap(n, dim, cosine))
                for s in range(0, len(at), 512):
                    for i, f in zip(at[s : s + 512], codes[dim].filters(unit([vectors[i] for i in at[s : s + 512]]))):
                        found[i] = np.sort(f)
            if vectors:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rep", "weight", "v")), pa.array(found, pa.list_(pa.int32()))], names=["rep", "weight", "v", "filters"])

    return run


def _links(f: int, cross: bool, ids, w, part, x: np.ndarray, filters: list, cosine: float):
    """Links first met under filter f: weights by vector, and a spanning forest."""
    links = x @ x.T >= cosine
    np.fill_diagonal(links, False)
    if cross:
        links &= part[:, None] != part[None, :]
    if not links.any():
        return None
    lower = [fs[fs < f] for fs in filters]
    every, at = np.unique(np.concatenate(lower), return_inverse=True)
    if len(every):
        met = np.zeros((len(ids), len(every)), np.float32)
        met[np.repeat(np.arange(len(ids)), [len(fs) for fs in lower]), at] = 1
        links &= met @ met.T < 0.5
    return (links * w[None, :]).sum(1), forest(links, ids)


_KEYS = ["dim", "f", "i", "j"]


def _meet(cosine: float):
    """Over rows sorted by filter and blocks; a group is two blocks at most."""

    def group(g: pd.DataFrame) -> list[tuple]:
        ids = g["rep"].to_numpy()
        if len(ids) < 2:
            return []
        _, f, i, j = g.iloc[0][_KEYS]
        found = _links(int(f), i != j, ids, g["weight"].to_numpy(), g["part"].to_numpy(), unit(g["v"].to_numpy()), list(g["filters"]), cosine)
        if found is None:
            return []
        return [(int(ids[k]), None, int(found[0][k])) for k in np.flatnonzero(found[0])] + [(a, b, None) for a, b in found[1]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        show = lambda rows: pd.DataFrame({"a": pd.Series([r[0] for r in rows], dtype="int64"), "b": pd.Series([r[1] for r in rows], dtype="Int64"), "n": pd.Series([r[2] for r in rows], dtype="Int64")})
        for b in batches:
            if not len(b):
                continue
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            k = b[_KEYS].to_numpy()
            at = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist()]
            yield show([r for x, y in zip(at[:-1], at[1:]) for r in group(b.iloc[x:y])])
            held = b.iloc[at[-1] :]
        if held is not None:
            yield show(group(held))

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    kind = "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("e"))
    largest = F.array_max(F.transform("e", F.abs))
    sound = F.coalesce(F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (largest > 0) & F.col("vec_id").isNotNull(), F.lit(False))
    # Doubles whose squares could leave the range of a double are brought to a largest component of one. -0 is 0.
    extreme = F.lit(kind == "double") & ~largest.between(1e-100, 1e100)
    good = rows.filter(sound).withColumn("scale", F.when(extreme, largest).otherwise(F.lit(1.0))).select("vec_id", F.when(extreme, F.transform("e", lambda c: c / F.col("scale") + F.lit(0.0))).otherwise(F.transform("e", lambda c: c + F.lit(0).cast(kind))).cast(f"array<{kind}>").alias("v"))
    classes = cut(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")))
    filtered = cut(classes.select("rep", "weight", "v").mapInArrow(lean(_filters(max(2, classes.count()), cosine)), f"rep long, weight long, v array<{kind}>, filters array<int>"))
    entries = filtered.select("rep", F.size("v").alias("dim"), F.explode("filters").alias("f"))
    sizes = entries.groupBy("dim", "f").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("c")).filter("c > 1")
    placed = entries.join(sizes, ["dim", "f"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("part"), j).alias("i"), F.greatest(F.col("part"), j).alias("j")))
    met = placed.select("rep", "dim", "f", "part", F.explode(tasks).alias("t")).select("rep", "dim", "f", "part", "t.i", "t.j").join(filtered, "rep")
    links = cut(met.repartition(shuffle_partitions(vectors.sparkSession), *_KEYS).sortWithinPartitions(*_KEYS).mapInPandas(lean(_meet(cosine)), "a long, b long, n long"))
    counts = links.filter("n IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    found = components(links.filter("b IS NOT NULL").select("a", "b"))
    # Members of a class: only classes of several rows need the join by vector, salted against very common ones.
    salts = 16
    several = classes.filter("weight > 1").select("v", "rep", "weight", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    members = good.select("vec_id", "v", F.pmod(F.hash("vec_id"), F.lit(salts)).alias("salt")).join(several, ["v", "salt"], "left").select("vec_id", F.coalesce("rep", "vec_id").alias("rep"), F.coalesce("weight", F.lit(1)).alias("weight"))
    told = members.join(counts, "rep", "left").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    bad = rows.filter(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return told.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
