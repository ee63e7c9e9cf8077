"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

A token's probability is P(class | context) * P(subclass | class, context) * P(token | leaf): every token hashes
to one of CLASSES x SUBCLASSES leaves, both softmax levels are linear in hashed features of the context (the
words 1, 2 and 3 places back, the last as skips, and the pair of the last two), and within a leaf the
smoothed unigram count decides, with one share for unknown tokens. Weights start at the unigram
masses, and so at about the base score. Training takes a gradient from every token of every learnable document:
each partition runs sparse gradient steps from the current weights, and changes are averaged row by row
over the partitions that made any, combined in Spark by chunks of the weight table. Scoring runs in
sparse numpy batches.

Texts are read once: a map task turns a buffer of documents into a block (its distinct tokens by hash, its documents
as positions in them). The tokens' counts are summed by hash range over all blocks and come back to
the blocks that asked; no vocabulary is ever collected or broadcast. Broadcast are the weights, of fixed
size. Tokens are told apart by 64 hash bits.

Null and empty texts are one token, the end. Null doc_ids are learnt from and not held out. Equal rows count as
often as they occur and get equal scores; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnp
from .common import SLICE_BYTES, cut, lean, shuffle_partitions, table
from .packed import pack, pack_sorted, range_cuts, unpack, unpack_sorted

U64 = np.uint64
CLASSES = SUBCLASSES = 32
FEATURES = 4
ROWS1, ROWS2 = 1 << 14, 1 << 16
EPOCHS, BATCH, RATE = 1, 4096, 0.3
#: Rows of floats handled at once, so that they stay in the cache.
CHUNK = 2048
#: Tokens of a batch to a weight row whose gradients are added one by one.
FEW = 8
BUFFER_BYTES = 12 << 20
END = U64(0x5DEECE66D1234567)
CHUNK_ROWS = 1 << 12
_BLOCK = "range int, block long, hashes binary, counts binary, ids binary, tokens binary, bounds binary"
_SCHEMA = pa.schema([("range", pa.int32()), ("block", pa.int64())] + [(c, pa.binary()) for c in ("hashes", "counts", "ids", "tokens", "bounds")])


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def leaf_of(h: np.ndarray) -> np.ndarray:
    return (textnp.mix(h ^ U64(0x1234567)) >> U64(40)).astype(np.int64) % (CLASSES * SUBCLASSES)


def tokens_of(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with the end of every document, and the documents' bounds."""
    hashes, sizes = [], []
    for s in textnp.slices([len(d) for d in docs], SLICE_BYTES):
        w = textnp.Words(docs[s])
        n = np.diff(w.bounds)
        out = np.full(len(w.starts) + len(n), END, U64)
        out[np.arange(len(w.starts)) + w.doc_of()] = w.hashes(lower=True)
        hashes.append(out)
        sizes.append(n + 1)
    return np.concatenate(hashes), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


def _blocks(ranges: int, held: Callable[[int | None], bool]):
    def flush(keys: list, docs: list[bytes], block: int) -> Iterator[pa.RecordBatch]:
        h, bounds = tokens_of(docs)
        vocab, local = np.unique(h, return_inverse=True)
        learn = np.repeat([not held(k) for k in keys], np.diff(bounds))
        counts = np.bincount(local[learn], minlength=len(vocab)).astype(np.int64)
        cuts = range_cuts(vocab, ranges)
        rows = [(r, block, pack_sorted(vocab[cuts[r] : cuts[r + 1]]), pack(counts[cuts[r] : cuts[r + 1]]), None, None, None) for r in np.flatnonzero(np.diff(cuts)).tolist()]
        ids = np.array([[k is not None, k or 0] for k in keys], np.int64)
        rows.append((-1, block, pack_sorted(vocab), None, ids.tobytes(), pack(local.astype(np.int32)), pack(bounds.astype(np.int64))))
        for i in range(0, len(rows), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 1024]), _SCHEMA)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, size, block = [], [], 0, TaskContext.get().partitionId() << 32
        for b in batches:
            for k, d in zip(b.column("doc_id").to_pylist(), textnp.texts(b.column("text"))):
                keys.append(k)
                docs.append(d)
                size += len(d)
                if size >= BUFFER_BYTES:
                    yield from flush(keys, docs, block)
                    keys, docs, size, block = [], [], 0, block + 1
        if docs:
            yield from flush(keys, docs, block)

    return run


def _counted(group: pd.DataFrame) -> pd.DataFrame:
    """Sums a hash range's counts over all blocks; answers each block, and tells the masses of the leaves (block -1)."""
    parts = [(b, unpack_sorted(h), unpack(c, np.int64)) for b, h, c in zip(group["block"], group["hashes"], group["counts"])]
    h = np.concatenate([p[1] for p in parts])
    words, inv = np.unique(h, return_inverse=True)
    total = np.zeros(len(words), np.int64)
    np.add.at(total, inv, np.concatenate([p[2] for p in parts]))
    leaf, known = leaf_of(words), total > 0
    size = CLASSES * SUBCLASSES
    masses = np.stack([np.bincount(leaf, total, size), np.bincount(leaf, known, size)]).astype(np.int64)
    ends = np.cumsum([len(p[1]) for p in parts])
    answers = [pack(total[inv[e - len(p[1]) : e]]) for p, e in zip(parts, ends)]
    return pd.DataFrame({"block": [p[0] for p in parts] + [-1], "range": int(group["range"].iloc[0]), "counts": [*answers, masses.tobytes()]})


class Model:
    """Weights as one table of rows: ROWS1 for classes, then ROWS2 for subclasses."""

    def __init__(self, masses: np.ndarray):
        """masses: (2, leaves) counts and distinct known tokens."""
        self.mass = (masses[0] + masses[1] + 1).astype(np.float64)
        by = self.mass.reshape(CLASSES, SUBCLASSES)
        self.b1 = np.log(by.sum(1) / by.sum()).astype(np.float32)
        self.b2 = np.log(by / by.sum(1, keepdims=True)).astype(np.float32)
        self.w = np.zeros((ROWS1 + ROWS2, CLASSES), np.float32)

    @staticmethod
    def context(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(FEATURES, tokens) feature hashes; before a document's start stands the end token."""
        place = np.arange(len(h)) - np.repeat(bounds[:-1], np.diff(bounds))
        back = []
        for d in (1, 2, 3):
            x = np.full(len(h), END, U64)
            x[d:] = h[:-d] if d < len(h) else x[d:]
            x[place < d] = END
            back.append(x)
        return np.stack([textnp.mix(x * U64(2 * k + 3) + U64(k)) for k, x in enumerate([*back, back[0] * U64(0x9E3779B1) ^ back[1]])])

    @staticmethod
    def rows1(ctx: np.ndarray) -> np.ndarray:
        return (ctx & U64(ROWS1 - 1)).astype(np.int64)

    @staticmethod
    def rows2(ctx: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ROWS1 + (textnp.mix(ctx + c.astype(U64) * U64(0xC2B2AE3D27D4EB4F)) & U64(ROWS2 - 1)).astype(np.int64)

    def logits(self, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
        z = self.w.take(rows[0], 0)
        for r in rows[1:]:
            z += self.w.take(r, 0)
        z += bias
        return z

    def leaf_scores(self, ctx: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Natural log of P(leaf | context)."""
        out = np.empty(len(leaf))
        for s in range(0, len(leaf), CHUNK):
            x, y = ctx[:, s : s + CHUNK], leaf[s : s + CHUNK]
            c, d, i = y // SUBCLASSES, y % SUBCLASSES, np.arange(len(y))
            total = np.zeros(len(y), np.float32)
            for rows, bias, target in ((self.rows1(x), self.b1, c), (self.rows2(x, c), self.b2[c], d)):
                z = self.logits(rows, bias)
                z -= z.max(1, keepdims=True)
                total += z[i, target]
                np.exp(z, out=z)
                total -= np.log(z.sum(1))
            out[s : s + CHUNK] = total
        return out

    def step(self, ctx: np.ndarray, leaf: np.ndarray, acc: np.ndarray) -> None:
        c, d, i = leaf // SUBCLASSES, leaf % SUBCLASSES, np.arange(len(leaf))
        for rows, bias, target in ((self.rows1(ctx), self.b1, c), (self.rows2(ctx, c), self.b2[c], d)):
            g = self.logits(rows, bias)
            g -= g.max(1, keepdims=True)
            np.exp(g, out=g)
            g /= g.sum(1, keepdims=True)
            g[i, target] -= 1
            entry = np.sort((rows << 20 | i).ravel())  # by row, then token
            flat, of = entry >> 20, entry & 0xFFFFF
            at = np.flatnonzero(np.concatenate(([True], flat[1:] > flat[:-1])))
            size = np.diff(np.append(at, len(flat)))
            squares = np.einsum("ij,ij->i", g, g)
            one = size == 1
            self._descend(flat[at[one]], of[at[one]], g, squares, acc)
            # Rows that several tokens touch need the sum: a pass for each of few tokens, one over segments for many.
            some = np.flatnonzero((size > 1) & (size <= FEW))
            if len(some):
                some = some[np.argsort(-size[some], kind="stable")]
                first, n = at[some], np.searchsorted(-size[some], -np.arange(FEW), "left")
                grad = g.take(of[first], 0)
                for k in range(1, FEW):
                    grad[: n[k]] += g.take(of[first[: n[k]] + k], 0)
                self._descend(flat[first], np.arange(len(grad)), grad, np.einsum("ij,ij->i", grad, grad), acc)
            many = size > FEW
            if many.any():
                grad = np.add.reduceat(g.take(of[np.repeat(many, size)], 0), np.cumsum(size[many]) - size[many])
                self._descend(flat[at[many]], np.arange(len(grad)), grad, np.einsum("ij,ij->i", grad, grad), acc)

    def _descend(self, row: np.ndarray, of: np.ndarray, grad: np.ndarray, squares: np.ndarray, acc: np.ndarray) -> None:
        """One step of distinct rows along the gradients ``of``, by the mean squares seen so far."""
        now = acc[row] + squares[of] / CLASSES
        acc[row] = now
        scale = (RATE / np.sqrt(now + 1.0))[:, None]
        for s in range(0, len(row), CHUNK):
            part = row[s : s + CHUNK]
            change = grad.take(of[s : s + CHUNK], 0)
            change *= scale[s : s + CHUNK]
            self.w[part] = self.w.take(part, 0) - change


def _payloads(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for r in b.to_pylist():
            ids = np.frombuffer(r["ids"], np.int64).reshape(-1, 2)
            keys = [int(k) if ok else None for ok, k in ids.tolist()]
            yield r, keys, unpack_sorted(r["hashes"]), unpack(r["tokens"], np.int32), unpack(r["bounds"], np.int64)


def _updates(model: Model, epoch: int, held: Callable[[int | None], bool]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        own.b1, own.b2, own.w = model.b1, model.b2, model.w.copy()
        acc, any_rows = np.zeros(len(own.w), np.float32), False
        for _, keys, vocab, local, bounds in _payloads(batches):
            h = vocab[local]
            ctx, leaf = Model.context(h, bounds), leaf_of(vocab)[local]
            learn = np.repeat([not held(k) for k in keys], np.diff(bounds))
            some = np.flatnonzero(learn)
            some = some[np.random.default_rng(epoch + len(h)).permutation(len(some))]
            for s in range(0, len(some), BATCH):
                own.step(ctx[:, some[s : s + BATCH]], leaf[some[s : s + BATCH]], acc)
                any_rows = True
        if any_rows:
            change = (own.w - model.w).astype(np.float16)
            rows = [(i, np.packbits(acc[i : i + CHUNK_ROWS] > 0).tobytes(), pack(change[i : i + CHUNK_ROWS][acc[i : i + CHUNK_ROWS] > 0].ravel())) for i in range(0, len(acc), CHUNK_ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["chunk", "rows", "change"])

    return run


def _averaged(group: pd.DataFrame) -> pd.DataFrame:
    total, n = np.zeros((CHUNK_ROWS, CLASSES)), np.zeros(CHUNK_ROWS)
    for rows, change in zip(group["rows"], group["change"]):
        on = np.unpackbits(np.frombuffer(rows, np.uint8))[:CHUNK_ROWS].astype(bool)
        total[on] += unpack(change, np.float16).reshape(-1, CLASSES)
        n += on
    return pd.DataFrame({"chunk": [int(group["chunk"].iloc[0])], "change": [(total / np.maximum(n, 1)[:, None]).astype(np.float32).tobytes()]})


def _scored(model: Model, n_all: int, v_all: int, held: Callable[[int | None], bool]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, keys, vocab, local, bounds in _payloads(batches):
            counts = np.concatenate([unpack(x["counts"], np.int64) for x in sorted(r["answers"], key=lambda x: x["range"])])
            leaves = leaf_of(vocab)
            within = np.log10((counts + 1) / model.mass[leaves])
            base = np.log10((counts + 1) / (n_all + v_all + 1))
            h = vocab[local]
            token = model.leaf_scores(Model.context(h, bounds), leaves[local]) / np.log(10) + within[local]
            add = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  every document has a token
            n = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([held(k) for k in keys]), pa.array(n), pa.array(add((counts > 0)[local].astype(np.int64))), pa.array(np.full(len(n), n_all)), pa.array(add(base[local])), pa.array(add(token))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def score(docs: DataFrame, held: Callable[[int | None], bool] = held_out, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = cut(cols.mapInArrow(lean(_blocks(4 * shuffle_partitions(spark), held)), _BLOCK))
    counted = cut(blocks.filter("range >= 0").select("range", "block", "hashes", "counts").groupBy("range").applyInPandas(_counted, "block long, range int, counts binary"))
    masses = np.zeros((2, CLASSES * SUBCLASSES), np.int64)
    for r in counted.filter("block < 0").select("counts").toLocalIterator():  # one fixed-size row to a hash range
        masses += np.frombuffer(r.counts, np.int64).reshape(2, -1)
    model = Model(masses)
    payload = blocks.filter("range < 0").select("block", "hashes", "ids", "tokens", "bounds")
    for epoch in range(epochs):
        changes = payload.mapInArrow(lean(_updates(model, epoch, held)), "chunk long, rows binary, change binary").groupBy("chunk").applyInPandas(_averaged, "chunk long, change binary")
        for r in changes.collect():  # the weight table's size
            model.w[r.chunk : r.chunk + CHUNK_ROWS] += np.frombuffer(r.change, np.float32).reshape(-1, CLASSES)
    answers = counted.filter("block >= 0").groupBy("block").agg(F.collect_list(F.struct("range", "counts")).alias("answers"))
    n_all, v_all = int(masses[0].sum()), int(masses[1].sum())
    return payload.join(answers, "block").mapInArrow(lean(_scored(model, n_all, v_all, held)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
