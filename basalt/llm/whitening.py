"""Embedding whitening by a two-pass covariance.

Every entry c becomes the integer ``floor(256 * c)``. The model is fitted on each distinct integer vector once
(``fit``): a first pass adds exact integers for the mean, a second one adds centred outer products, one NumPy matrix
product to a batch, and both merge their partial sums by treeAggregate. LAPACK's symmetric eigensolver gives the
components, whose projection is broadcast to one pass over all rows (``transform``). A third pass over the fitted
vectors measures how far the covariance of what was whitened is from the identity.

What moves is one packed copy of every distinct vector (two bytes to a number where all numbers of the vector fit), after the
map tasks have dropped their own repetitions, so that a vector that a third of all rows carry costs one row to a task. The driver
gets matrices of the vectors' dimension, never vectors.

Rows whose vector is null, or holds a null or non-finite number or one whose integer passes 64 bits, are dropped.
So are those of another length than most distinct vectors have (of equally common lengths the greatest counts). Repeated
rows and ids stay, each with its own result, and null ids stay too. A component without variance (rank below ``k``, or a single
vector) has null for ``whitened`` and is left out of ``identity_error``; vectors with fewer than ``k`` numbers have as many
components as numbers. A deviation past 64 bits is null. An empty table gives no rows. Columns of the input that are called as the new ones are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean, table

K = 4
SCALE = 256.0
#: Rows whose centred vectors are held as doubles at once.
ROWS = 8192
_LONG = 2**63


@dataclass
class Whitening:
    """n distinct vectors with sums S; ``components`` holds one unit vector to a row, by falling eigenvalue."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    trace: float
    components: np.ndarray
    identity_error: float = 0.0

    @property
    def dim(self) -> int:
        return len(self.sums)

    @property
    def live(self) -> np.ndarray:
        """Which components have variance beyond rounding."""
        return self.eigenvalues > max(self.trace, 0.0) * self.dim * 1e-14

    def projection(self) -> np.ndarray:
        """dim x k, the components over the roots of their eigenvalues; NaN without variance."""
        scale = np.where(self.live, np.sqrt(np.where(self.live, self.eigenvalues, 1.0)), np.nan)
        return (self.components / scale[:, None]).T

    def explained(self) -> list[float]:
        return [max(float(e), 0.0) / self.trace if self.trace > 0 else 0.0 for e in self.eigenvalues]


def quantised(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of an array<double> column: rows of one length and their integers as a matrix, length by length, without the rows that are dropped."""
    if not len(column):
        return
    offsets = column.offsets.to_numpy().astype(np.int64)
    with np.errstate(all="ignore"):
        x = np.floor(column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] * SCALE)
        bad = ~(np.abs(x) < _LONG)
    offsets = offsets - offsets[0]
    wrong = np.concatenate(([0], np.cumsum(bad)))
    length = np.diff(offsets)
    good = (wrong[offsets[1:]] == wrong[offsets[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    for d in np.unique(length[good]).tolist():
        rows = np.flatnonzero(good & (length == d))
        for at in range(0, len(rows), ROWS):
            part = rows[at : at + ROWS]
            yield part, x[offsets[part][:, None] + np.arange(d)[None, :]].astype(np.int64)


def encoded(x: np.ndarray) -> list[bytes]:
    """Vectors as bytes of the least width that holds all numbers of the vector; equal bytes are equal vectors."""
    if not x.shape[1]:
        return [b"\x02"] * len(x)
    out = np.empty(len(x), object)
    low, high = x.min(1), x.max(1)
    width = np.where((low >= -(2**15)) & (high < 2**15), 2, np.where((low >= -(2**31)) & (high < 2**31), 4, 8))
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        data, step = x[at].astype(f"<i{w}").tobytes(), w * x.shape[1]
        out[at] = [bytes([w]) + data[i : i + step] for i in range(0, len(data), step)]
    return out.tolist()


def decoded(column: pa.Array, dim: int) -> Iterator[np.ndarray]:
    """Matrices of the vectors, all of one length."""
    by: dict[int, list[bytes]] = {}
    for b in column.to_pylist():
        by.setdefault(b[0], []).append(b[1:])
    for w, rows in by.items():
        for at in range(0, len(rows), ROWS):
            part = rows[at : at + ROWS]
            yield np.frombuffer(b"".join(part), f"<i{w}").reshape(len(part), dim).astype(np.int64)


def _largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as 64-bit integers where they fit, else as Python's."""
    most = n * _largest(x) + max((abs(s) for s in sums), default=0)
    wide = np.int64 if most < _LONG else object
    return x.astype(wide) * n - np.array(sums, wide)


def _encoded_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, x in quantised(b.column("embedding")):
            yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(x), pa.int32()), pa.array(encoded(x), pa.binary())], names=["dim", "x"])


def _partials(add: Callable, zero: Callable) -> Callable:
    """One row to a partition: what ``add`` has summed over its matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = zero()
        for b in batches:
            total = add(total, b.column("x"))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["part"])

    return run


def _merged(fitted: DataFrame, add: Callable, zero: Callable):
    """Partial sums of all partitions, merged in a tree on the executors."""
    plus = lambda a, b: tuple(x + y for x, y in zip(a, b))
    parts = fitted.mapInArrow(lean(_partials(add, zero)), "part binary").rdd
    return parts.treeAggregate(zero(), lambda a, r: plus(a, pickle.loads(r.part)), plus, depth=3)


def vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    """dim, x: every distinct integer vector once, packed."""
    return df.select(F.col(column).cast("array<double>").alias("embedding")).mapInArrow(lean(_encoded_rows), "dim int, x binary").distinct()


def fit(df: DataFrame, column: str = "embedding", k: int = K) -> Whitening:
    """The first k components of the covariance over distinct integer vectors."""
    every = cut(vectors(df, column))
    most = every.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not most or not most[0].dim:
        return Whitening(0, [], np.empty(0), 0.0, np.empty((0, 0)))
    dim, fitted = most[0].dim, every.filter(F.col("dim") == most[0].dim).select("x")

    def add_sums(total, batch):
        n, sums = total
        for x in decoded(batch, dim):
            wide = np.int64 if _largest(x) * len(x) < _LONG else object
            n, sums = n + len(x), sums + x.astype(wide).sum(0).astype(object)
        return n, sums

    n, s = _merged(fitted, add_sums, lambda: (0, np.zeros(dim, object)))
    sums = [int(v) for v in s]

    def add_products(total, batch):
        (g,) = total
        for x in decoded(batch, dim):
            c = deviations(x, n, sums).astype(np.float64) / n
            g = g + c.T @ c
        return (g,)

    (g,) = _merged(fitted, add_products, lambda: (np.zeros((dim, dim)),))
    v = g / n
    value, vector = np.linalg.eigh((v + v.T) / 2)
    value, vector = value[::-1][:k], vector.T[::-1][:k]
    sign = np.sign(vector[np.arange(len(vector)), np.abs(vector).argmax(1)])
    model = Whitening(n, sums, value, float(np.trace(v)), vector * sign[:, None])
    live = model.live
    if live.any():
        p, m = model.projection()[:, live], int(live.sum())

        def add_whitened(total, batch):
            one, two = total
            for x in decoded(batch, dim):
                w = (deviations(x, n, sums).astype(np.float64) / n) @ p
                one, two = one + w.sum(0), two + w.T @ w
            return one, two

        one, two = _merged(fitted, add_whitened, lambda: (np.zeros(m), np.zeros((m, m))))
        model.identity_error = float(np.abs(two / n - np.outer(one / n, one / n) - np.eye(m)).max())
    return model


def transform(df: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """The rows that can be whitened, with ``whitened`` (array of k doubles) and ``deviation``."""
    spark, dim, n, sums = df.sparkSession, model.dim, model.n, model.sums
    names = [c for c in df.columns if c not in ("whitened", "deviation")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names] + ["deviation long", "whitened array<double>"])
    if not dim:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model.projection())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            for rows, x in quantised(b.column(b.num_columns - 1)):
                if x.shape[1] != dim:
                    continue
                dev = deviations(x, n, sums)
                if dev.dtype != object and dim * int(np.abs(dev).max()) ** 2 >= _LONG:
                    dev = dev.astype(object)
                square = [v if (v := int(t)) < _LONG else None for t in (dev * dev).sum(1)]
                white = (dev.astype(np.float64) / n) @ p
                lists = pa.ListArray.from_arrays(np.arange(0, white.size + 1, p.shape[1], dtype=np.int32), pa.array(white.ravel(), from_pandas=True))
                part = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(square, pa.int64()), lists], names=[*names, "deviation", "whitened"])

    return df.select(*(F.col(f"`{c}`") for c in names), F.col(column).cast("array<double>").alias("__vector")).mapInArrow(lean(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    model = fit(rows)
    shares = F.array(*(F.lit(e) for e in model.explained())) if model.dim else F.array(F.lit(0.0))
    long = transform(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
