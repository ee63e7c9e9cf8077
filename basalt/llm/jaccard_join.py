"""N-gram Jaccard join with token-combination prefixes.

A document's set is its distinct word shingles, each named by 64 hash bits; equal sets form a class with the
smallest doc_id as representative. All shingles of the corpus are counted one by one, in blocks by range; a hashed table of fixed
size keeps the largest count of each cell, orders shingles from rare to frequent and parts them into two kinds. A set's prefix is extended by one
shingle for each group of frequent shingles: two sets that overlap enough then share, within their
prefixes, a rare shingle or two frequent ones of one group. Rare prefix shingles are indexed alone,
frequent ones as pairs within their group; groups grow with the size level of the set, so a prefix of p
shingles has about 1.5 p pairs.

Index entries meet in blocks by key range. Few sets under a key become candidate pairs. Small groups of
candidates are compared as one matrix, so that a set travels once and not with every pair; pairs of larger groups are
verified one by one. Keys of more than ``FEW`` sets only tie those sets to a crowd; crowds are cut
into blocks by size level and hash, and every two blocks that may hold similar sets are compared as
matrices. Out of a matrix come a spanning forest of its links and every set's number of links, and each
pair of sets is compared in one matrix. So no group of copies or near copies is expanded into pairs of
rows, and every link between different sets is verified and counted.

``n_links`` of a row counts the other rows that are similar to it, equal ones included.

Null and empty texts have empty sets and link with nothing; shorter texts than a shingle are one shingle.
Rows with equal doc_ids and equal texts are one class; with different texts the id is in two classes, every text of it is
compared, and its rows report the smallest component and the links of the id. Null doc_ids are reported unlinked, each row on its own. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom, textnp
from ..operators.components import components
from .common import SLICE_BYTES, checkpoint_dir, cut, lean, remove, shuffle_partitions, table, trim
from .packed import pack, pack_sorted, range_cuts, unpack, unpack_sorted

U64 = np.uint64
#: Cells of the count table, each with the count of its most frequent shingle: shingles that occur once, however many, leave no noise in it.
SKETCH_BITS = 23
SKETCH = 1 << SKETCH_BITS
SKETCH_CHUNK = 1 << 17
#: Sets under one key that are paired directly.
FEW = 12
#: Shingles of a block of a crowd, about; and its sets, about: two blocks are compared as one matrix.
BLOCK_SHINGLES = 400_000
BLOCK_SETS = 1024
#: Sets of a group of candidates that is compared at once, at most.
GROUP_SETS = 2048
BUFFER_ENTRIES = 600_000
BUFFER_SHINGLES = 2_000_000
#: Cells of the histogram that bounds an overlap from above.
CELLS = 64
#: Bits of an entry that are kept: keys that meet by chance give candidates, which are verified; entries are of one set if 40 bits of its name and its size agree.
KEY_BITS = U64(0xFFFFFFFFFF000000)
NAME_BITS = (1 << 40) - 1


def shingle_sets(docs: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    out = []
    for s in textnp.slices([len(d) for d in docs], SLICE_BYTES):
        w = textnp.Words(docs[s])
        h = w.hashes(lower=True)
        every = textnp.windows(h, k)
        for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(every[a : b - k + 1]))
            elif b > a:
                out.append(textnp.windows(h[a:b], b - a) ^ U64(b - a))
            else:
                out.append(np.empty(0, U64))
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        a = textnp.mix(np.array([textnp.mix(s + U64(1)).sum(dtype=U64) + U64(len(s))]))[0]
        b = textnp.mix(np.array([textnp.mix(s * U64(0x9E3779B97F4A7C15) + U64(77)).sum(dtype=U64)]))[0]
    return int(a.view(np.int64)), int(b.view(np.int64))


class Prefixes:
    """Signatures of sets for a threshold num / den under a count table, which is kept in one byte a cell."""

    def __init__(self, counts: np.ndarray, threshold: Fraction):
        self.t = threshold
        mean = float(counts.mean())
        frequent = mean + 32 + 6 * math.sqrt(mean)
        self.counts = np.empty(len(counts), np.uint8)
        for i in range(0, len(counts), SKETCH_CHUNK):  # a strip at a time: the driver holds few copies
            self.counts[i : i + SKETCH_CHUNK] = np.minimum(counts[i : i + SKETCH_CHUNK] * (250 / frequent), 250).astype(np.uint8)
        self.frequent = 250
        self.base = -math.log(threshold) * 1.0001

    def level(self, n: int) -> int:
        return int(math.log(n) / self.base)

    def groups(self, level: int) -> int:
        most = math.ceil(math.exp((level + 1) * self.base)) + 1
        return max(1, (most - math.ceil(self.t * most) + 1) // 3)

    def keys(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        if n == 0 or Fraction(n, n + 1) < self.t:  # only an equal set is similar
            return np.empty(0, U64)
        level = self.level(n)
        need = math.ceil(self.t * n)
        g = [(x, self.groups(x)) for x in (level, level + 1)]
        count = self.counts[(s & U64(SKETCH - 1)).astype(np.int64)]
        order = np.lexsort((s, count))[: min(n, n - need + 1 + max(c for _, c in g))]
        first, rare = s[order], count[order] < self.frequent
        out = [textnp.mix(first[rare] + U64(5))]
        for x, c in g:
            top = first[: min(n, n - need + 1 + c)]
            many = np.sort(top[~rare[: len(top)]])
            if len(many) < 2:
                continue
            group = (textnp.mix(many ^ U64(0xABCDEF)) % U64(c)).astype(np.int64)
            for part in np.split(many[np.argsort(group, kind="stable")], np.cumsum(np.bincount(group, minlength=c))[:-1]):
                if len(part) > 1:
                    i, j = np.triu_indices(len(part), 1)
                    out.append(textnp.mix(textnp.mix(part[i] + U64(x)) * U64(0x9E3779B97F4A7C15) + part[j]))
        return np.unique(np.concatenate(out) & KEY_BITS)


def _first_pass(k: int, ranges: int):
    """Size and name of every set, and all shingles of the corpus in packed blocks by range, cell first."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        s = np.concatenate(held)
        key = np.sort(((s << U64(64 - SKETCH_BITS)) | (s >> U64(SKETCH_BITS))) & KEY_BITS)
        cuts = range_cuts(key, ranges)
        at = np.flatnonzero(np.diff(cuts)).tolist()
        columns = [pa.nulls(len(at), pa.int64())] * 4 + [pa.array(at, pa.int32()), pa.array([pack_sorted(key[cuts[r] : cuts[r + 1]]) for r in at], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n", "hi", "lo", "range", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            docs, keys = textnp.texts(b.column("text")), b.column("doc_id").to_pylist()
            for part in textnp.slices([len(d) for d in docs], 4 * SLICE_BYTES):
                sets = shingle_sets(docs[part], k)
                rows = [(key, len(s), *digest(s)) for key, s in zip(keys[part], sets)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows)), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], names=names)
                held.append(np.concatenate(sets))
                n += len(held[-1])
                if n >= BUFFER_SHINGLES:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return run


def _most(group: pd.DataFrame) -> pd.DataFrame:
    """Of one range of shingles: the count of the most frequent one of each cell."""
    key = np.sort(np.concatenate([unpack_sorted(x) for x in group["keys"]]))
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count, cell = np.diff(np.append(at, len(key))), (key[at] >> U64(64 - SKETCH_BITS)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    cells = np.zeros(cell[-1] - cell[0] + 1, np.uint16)
    cells[cell[begin] - cell[0]] = np.minimum(np.maximum.reduceat(count, begin), 65535)
    return pd.DataFrame({"first": [cell[0]], "counts": [pack(cells)]})


def _table(parts) -> np.ndarray:
    """The count table out of the rows of all ranges; two of them may share a cell."""
    counts = np.zeros(SKETCH, np.float32)
    for r in parts:
        c = unpack(r.counts, np.uint16)
        strip = counts[r.first : r.first + len(c)]
        np.maximum(strip, c, out=strip)
    return counts


_ENTRY = "range int, keys binary, sets binary, ids binary, sizes binary"


def _entries(k: int, prefixes: Prefixes, ranges: int):
    def flush(parts: list) -> Iterator[pa.RecordBatch]:
        key, name, ids, n = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ids, n, name, key))
        key, name, ids, n = key[order], name[order], ids[order], n[order]
        first = np.concatenate(([True], (key[1:] != key[:-1]) | (name[1:] != name[:-1]) | (n[1:] != n[:-1])))  # copies within the buffer count once
        key, name, ids, n = key[first], name[first], ids[first], n[first]
        cuts = range_cuts(key, ranges)
        rows = []
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            s = slice(cuts[r], cuts[r + 1])
            rows.append((r, pack_sorted(key[s]), pack(name[s]), pack(ids[s]), pack(n[s].astype(np.int32))))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), *(pa.array([x[i] for x in rows], pa.binary()) for i in range(1, 5))], names=["range", "keys", "sets", "ids", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            for doc, s in zip(b.column("doc_id").to_pylist(), shingle_sets(textnp.texts(b.column("text")), k)):
                key = prefixes.keys(s) if doc is not None else np.empty(0, U64)
                if len(key):
                    parts.append((key, np.full(len(key), digest(s)[0] & NAME_BITS, np.int64), np.full(len(key), doc, np.int64), np.full(len(key), len(s), np.int64)))
                    held += len(key)
                    if held >= BUFFER_ENTRIES:
                        yield from flush(parts)
                        parts, held = [], 0
        if parts:
            yield from flush(parts)

    return run


def _meet(threshold: Fraction):
    """Of one key range: candidate pairs of representatives (crowd false), and ties of crowds (crowd true)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        key = np.concatenate([unpack_sorted(x) for x in group["keys"]])
        name, ids = (np.concatenate([unpack(x, np.int64) for x in group[c]]) for c in ("sets", "ids"))
        n = np.concatenate([unpack(x, np.int32) for x in group["sizes"]]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        many = np.zeros(len(key), bool)
        many[order[1:][same]] = many[order[:-1][same]] = True
        at = np.flatnonzero(many)
        at = at[np.lexsort((ids[at], n[at], name[at], key[at]))]
        key, name, ids, n = key[at], name[at], ids[at], n[at]
        first = np.concatenate(([True], (key[1:] != key[:-1]) | (name[1:] != name[:-1]) | (n[1:] != n[:-1]))) if len(key) else np.empty(0, bool)
        key, ids, n = key[first], ids[first], n[first]  # a class by its smallest document
        out = [np.empty((0, 3), np.int64)]
        if len(key):
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(begin, len(key)))
            place = np.arange(len(key)) - np.repeat(begin, size)
            count = np.repeat(size, size)
            for d in range(1, FEW):
                i = np.flatnonzero((count <= FEW) & (place + d < count))
                a, b = ids[i], ids[i + d]
                near = np.minimum(n[i], n[i + d]) * threshold.denominator >= np.maximum(n[i], n[i + d]) * threshold.numerator
                out.append(np.stack([np.minimum(a, b), np.maximum(a, b), np.zeros(len(a), np.int64)], 1)[near])
            big = np.flatnonzero(count > FEW)
            if len(big):
                least = np.minimum.reduceat(ids, begin)
                tie = np.repeat(least, size)[big]
                out.append(np.stack([tie, ids[big], np.ones(len(big), np.int64)], 1))
        rows = np.unique(np.concatenate(out), axis=0)
        rows = rows[(rows[:, 0] != rows[:, 1]) | (rows[:, 2] == 1)]
        return pd.DataFrame({"a": rows[:, 0], "b": rows[:, 1], "crowd": rows[:, 2] == 1})

    return run


def _sets(k: int, wanted: np.ndarray, histograms: bool):
    """Sizes of the documents that may be wanted, and either histograms of their shingles or the shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.is_valid(b.column("doc_id")))
            b = b.filter(pa.array(bloom.maybe(wanted, b.column("doc_id").to_numpy(zero_copy_only=False)), pa.bool_()))
            if b.num_rows:
                sets = shingle_sets(textnp.texts(b.column("text")), k)
                if histograms:
                    last = [np.minimum(np.bincount((s >> U64(40)).astype(np.int64) % CELLS, minlength=CELLS), 65535).astype("<u2").tobytes() for s in sets]
                else:
                    last = [pack_sorted(s) for s in sets]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(last, pa.binary())], names=["doc_id", "n", "cells" if histograms else "shingles"])

    return run


def _shingles(cols: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """doc_id, n, shingles of the ids wanted, and of few others that the filter passes: computed where the texts are, so that no other set moves or is stored."""
    return cols.mapInArrow(lean(_sets(k, bloom.build(wanted), False)), "doc_id long, n long, shingles binary")


def _possible(t: Fraction):
    """Pairs whose histograms allow the overlap that the threshold needs; cells that are full allow anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, CELLS).astype(np.int64) for c in ("cx", "cy"))
                na, nb = (b.column(c).to_numpy(zero_copy_only=False) for c in ("nx", "ny"))
                most = np.where((x.max(1) >= 65535) | (y.max(1) >= 65535), np.minimum(na, nb), np.minimum(x, y).sum(1))
                yield b.select(["a", "b"]).filter(pa.array(similar(most, na, nb, t)))

    return run


def similar(overlap, n_a, n_b, t: Fraction):
    return t.denominator * overlap >= t.numerator * (n_a + n_b - overlap)


def _verify(t: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                x, y = unpack_sorted(x), unpack_sorted(y)
                keep.append(bool(similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), t)))
            if any(keep):
                yield b.select(["a", "b"]).filter(pa.array(keep))

    return run


def forest(links: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of a boolean link matrix."""
    out, todo = [], np.ones(len(ids), bool)
    for root in range(len(ids)):
        if not todo[root]:
            continue
        todo[root], stack = False, [root]
        while stack:
            i = stack.pop()
            for j in np.flatnonzero(links[i] & todo).tolist():
                todo[j] = False
                out.append((int(ids[i]), int(ids[j])))
                stack.append(j)
    return out


def _linked(sets: list[np.ndarray], ids: np.ndarray, weights: np.ndarray, side: np.ndarray, t: Fraction) -> pd.DataFrame:
    """Links between different sides: a spanning forest (a, b), and the weight that each set links with (a, n)."""
    n = np.array([len(s) for s in sets], np.int64)
    flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    u, inv, c = np.unique(flat, return_inverse=True, return_counts=True)
    col = np.cumsum(c > 1) - 1
    keep = c[inv] > 1
    of, at = of[keep], col[inv[keep]]
    overlap, width = np.zeros((len(sets), len(sets)), np.float32), 4096
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    for w in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        s = slice(np.searchsorted(at, w), np.searchsorted(at, w + width))
        m = np.zeros((len(sets), width), np.float32)
        m[of[s], at[s] - w] = 1
        overlap += m @ m.T
    links = np.empty(overlap.shape, bool)
    for w in range(0, len(sets), 256):  # a strip at a time in whole numbers
        links[w : w + 256] = similar(overlap[w : w + 256].astype(np.int64), n[w : w + 256, None], n[None, :], t)
    del overlap
    np.fill_diagonal(links, False)
    links &= side[:, None] != side[None, :]
    pairs, n_links = forest(links, ids), links @ weights
    rows = [(x, y, None) for x, y in pairs] + [(int(ids[i]), None, int(n_links[i])) for i in np.flatnonzero(n_links)]
    return pd.DataFrame({"a": pd.Series([x[0] for x in rows], dtype="int64"), "b": pd.Series([x[1] for x in rows], dtype="Int64"), "n": pd.Series([x[2] for x in rows], dtype="Int64")})


def _distinct(group: pd.DataFrame) -> pd.DataFrame:
    return group if group["doc_id"].is_unique else group.drop_duplicates(["doc_id", "shingles"])


def _compare_group(t: Fraction):
    """A small group of candidates, whose sets come one by one."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = _distinct(group)
        return _linked([unpack_sorted(x) for x in g["shingles"]], g["doc_id"].to_numpy(), g["weight"].to_numpy(), g["side"].to_numpy(), t)

    return run


def _pack_block(group: pd.DataFrame) -> pd.DataFrame:
    """A block of a crowd in one row: its shingles once, and each set by its places among them, which for near copies are mostly neighbours."""
    g = _distinct(group)
    sets = [unpack_sorted(x) for x in g["shingles"]]
    u, place = np.unique(np.concatenate(sets), return_inverse=True)
    n = np.array([len(s) for s in sets], np.int32)
    step = np.diff(place, prepend=0).astype(np.int32)
    start = np.concatenate(([0], np.cumsum(n)[:-1]))
    step[start] = place[start]
    out = {c: [g[c].iloc[0]] for c in ("crowd_id", "level", "i", "nb", "na", "nu")}
    packed = (pack(g["doc_id"].to_numpy(np.int64)), pack(n), pack(g["weight"].to_numpy(np.int64)), pack_sorted(u), pack(step))
    return pd.DataFrame(out | {c: [x] for c, x in zip(("docs", "sizes", "weights", "shingles", "places"), packed)})


_PLACE = ("level", "i", "nb", "na", "nu")
_GATHERED = "crowd_id long, level int, i int, nb int, na int, nu int, docs binary, sizes binary, weights binary, shingles binary, places binary, a long, b long, n_links long"


def _gathered(t: Fraction):
    """A block of a crowd packed, or the links of a small group."""
    names = [c.split()[0] for c in _GATHERED.split(", ")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = _compare_group(t)(group).rename(columns={"n": "n_links"}) if group["whole"].iloc[0] else _pack_block(group)
        return out.reindex(columns=names)

    return run


def _unpack_block(row) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    n, u, step = unpack(row.sizes, np.int32), unpack_sorted(row.shingles), unpack(row.places, np.int32)
    sets = [u[np.cumsum(x)] for x in np.split(step, np.cumsum(n)[:-1])]
    return unpack(row.docs, np.int64), sets, unpack(row.weights, np.int64)


def _compare(t: Fraction):
    """Two blocks of a crowd, or one with itself."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, sets, weights, side = [], [], [], []
        for row in group.itertuples():
            d, x, w = _unpack_block(row)
            ids.append(d)
            sets += x
            weights.append(w)
            # A side is not compared with itself: blocks of two have other tasks for that.
            kind, i, j = row.t["kind"], row.t["i"], row.t["j"]
            side.append(np.full(len(d), row.level) if kind == 1 else d if i == j else np.full(len(d), row.i))
        ids, weights, side = (np.concatenate(x) for x in (ids, weights, side))
        return _linked(sets, ids, weights, side, t)

    return run


def _verified(pairs: DataFrame, cols: DataFrame, k: int, t: Fraction) -> DataFrame:
    """The pairs that are similar."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    few = _shingles(cols, k, ends)
    x, y = few.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), few.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return cut(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(lean(_verify(t)), "a long, b long"))


def join(docs: DataFrame, k: int = 4, threshold: Fraction = Fraction(85, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return links(docs, k, threshold).drop("n_links")


def links(docs: DataFrame, k: int = 4, threshold: Fraction = Fraction(85, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links."""
    spark = docs.sparkSession
    t, ranges = threshold, 4 * shuffle_partitions(spark)
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    place = f"{checkpoint_dir(spark)}/shingles-{uuid.uuid4().hex}"
    cols.mapInArrow(lean(_first_pass(k, ranges)), "doc_id long, n long, hi long, lo long, range int, keys binary").write.parquet(place)
    first = spark.read.parquet(place)
    sets = cut(first.filter("range IS NULL").select("doc_id", "n", "hi", "lo"))
    most = cut(first.filter("range IS NOT NULL").select("range", "keys").groupBy("range").applyInPandas(_most, "first long, counts binary"))
    remove(spark, place)
    counts = _table(most.collect())  # SKETCH numbers
    prefixes = Prefixes(counts, t)
    del counts
    trim()
    met = cut(cols.mapInArrow(lean(_entries(k, prefixes, ranges)), _ENTRY).groupBy("range").applyInPandas(_meet(t), "a long, b long, crowd boolean"))
    crowd = components(met.filter("crowd").select("a", "b"))
    in_crowd = crowd.select("id", F.col("component").alias("crowd_id"))
    # Pairs within one crowd are compared there.
    pairs = met.filter("NOT crowd").select("a", "b").distinct()
    pairs = cut(
        pairs.join(in_crowd.select(F.col("id").alias("a"), F.col("crowd_id").alias("ca")), "a", "left")
        .join(in_crowd.select(F.col("id").alias("b"), F.col("crowd_id").alias("cb")), "b", "left")
        .filter(~F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)))
        .select("a", "b")
    )
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(in_crowd.select("id")).distinct()
    # Histograms of candidates only, computed where the texts are; the filter passes few others, and the join drops those.
    bits = bloom.build(wanted)
    cells = cut(cols.mapInArrow(lean(_sets(k, bits, True)), "doc_id long, n long, cells binary").join(wanted, F.col("doc_id") == wanted["id"], "left_semi"))
    x, y = (cells.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{d}"), F.col("cells").alias(f"c{d}")) for c, d in (("a", "x"), ("b", "y")))
    pairs = cut(pairs.join(x, "a").join(y, "b").select("a", "b", "nx", "ny", "cx", "cy").mapInArrow(lean(_possible(t)), "a long, b long").distinct())
    # Classes of equal sets by their smallest document, with their rows.
    names = sets.filter("n > 0 AND doc_id IS NOT NULL")
    classes = cut(names.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).filter("c > 1"))
    weights = classes.groupBy("rep").agg(F.max("c").alias("weight"))
    sized = cut(names.select("doc_id", "n").distinct().join(wanted, F.col("doc_id") == wanted["id"], "left_semi").join(weights, F.col("doc_id") == F.col("rep"), "left").select("doc_id", "n", F.coalesce("weight", F.lit(1)).cast("long").alias("weight")))
    group = cut(components(pairs).select("id", F.col("component").alias("group_id")))
    grouped = sized.join(group, F.col("doc_id") == F.col("id")).select("doc_id", "n", "weight", "group_id")
    small = cut(grouped.groupBy("group_id").agg(F.sum("n").alias("n"), F.count("*").alias("c")).filter((F.col("n") <= BLOCK_SHINGLES) & (F.col("c") <= GROUP_SETS)).select("group_id"))
    large = cut(pairs.join(group.select(F.col("id").alias("a"), "group_id"), "a").join(small, "group_id", "left_anti").select("a", "b"))
    linked = large if large.isEmpty() else _verified(large, cols, k, t)
    # Crowds: blocks by (crowd, size level, hash); a task has block i of a level with block j >= i of it, or with one of the next level.
    sized = sized.join(in_crowd, F.col("doc_id") == F.col("id")).select("doc_id", "n", "weight", "crowd_id").withColumn("level", F.floor(F.log("n") / F.lit(prefixes.base)).cast("int"))
    n_blocks = sized.groupBy("crowd_id", "level").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("blocks"))
    here, above, below = (n_blocks.select("crowd_id", (F.col("level") + d).alias("level"), F.col("blocks").alias(c)) for d, c in ((0, "nb"), (-1, "na"), (1, "nu")))
    placed = sized.join(here, ["crowd_id", "level"]).join(above, ["crowd_id", "level"], "left").join(below, ["crowd_id", "level"], "left").withColumn("i", F.pmod(F.xxhash64("doc_id"), F.col("nb")).cast("int"))
    upto = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda level, kind, i, j: F.struct(level.alias("l"), F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    tasks = F.concat(
        F.transform(upto("nb"), lambda j: task(F.col("level"), 0, F.least(F.col("i"), j), F.greatest(F.col("i"), j))),
        F.transform(upto("na"), lambda j: task(F.col("level"), 1, F.col("i"), j)),
        F.transform(upto("nu"), lambda j: task(F.col("level") - 1, 1, j, F.col("i"))),
    )
    # Pairs within a crowd are compared there, not in a group of candidates.
    whole = grouped.join(small, "group_id", "left_semi").join(in_crowd, F.col("doc_id") == F.col("id"), "left").select("doc_id", "n", "weight", F.col("group_id").alias("crowd_id"), F.coalesce("crowd_id", "doc_id").alias("side"), F.lit(True).alias("whole"), *(F.lit(0).alias(c) for c in _PLACE))
    parts = placed.select("doc_id", "n", "weight", "crowd_id", F.lit(0).cast("long").alias("side"), F.lit(False).alias("whole"), *_PLACE).na.fill(0, ["na", "nu"]).unionByName(whole)
    # A set that has a place meets all its places in one join.
    parts = cut(parts)
    met_ = parts.join(_shingles(cols, k, parts.select(F.col("doc_id").alias("id")).distinct()), ["doc_id", "n"]).groupBy("whole", "crowd_id", *_PLACE).applyInPandas(_gathered(t), _GATHERED)
    met_ = cut(met_)
    crowded = met_.filter("docs IS NOT NULL").drop("a", "b", "n_links").withColumn("t", F.explode(tasks)).groupBy("crowd_id", "t").applyInPandas(_compare(t), "a long, b long, n long")
    compared = cut(crowded.unionByName(met_.filter("docs IS NULL").select("a", "b", F.col("n_links").alias("n"))))
    edges = components(linked.unionByName(compared.filter("b IS NOT NULL").select("a", "b")))
    ends = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    single = ends.join(weights.select(F.col("rep").alias("b"), "weight"), "b", "left").select("a", F.coalesce("weight", F.lit(1)).alias("n"))
    counted = single.unionByName(compared.filter("n IS NOT NULL").select("a", "n")).groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
    edges = cut(edges.join(counted, "id", "left"))
    # A class takes the component and the links of its smallest document; classes of one are their own.
    salts = 16
    members = names.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(classes.select("hi", "lo", "rep", "c", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")), ["hi", "lo", "salt"]).select("doc_id", "rep", "c")
    spread = members.join(edges.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("doc_id").alias("id"), F.coalesce("component", "rep").alias("component"), (F.coalesce("n_links", F.lit(0)) + F.col("c") - 1).alias("n_links"))
    of = spread.unionByName(edges).groupBy("id").agg(F.min("component").alias("component"), F.max("n_links").alias("n_links"))
    return sets.join(of, sets["doc_id"] == of["id"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "documents"))
