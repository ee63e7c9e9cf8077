"""Best-fit packing of token sequences by a configuration linear program.

Documents are tokenized once into pieces of at most ``capacity`` tokens. Only the histogram of piece
lengths (at most ``capacity`` rows, whatever the corpus) goes to the driver, which solves the
configuration program over it: multiplicative weights keep a price for each length, and knapsack dynamic
programming prices the fills of a sequence; lengths that are covered already get cheaper. The
fractional solution is rounded down, then up where the pieces suffice; what is left is placed best
fit in decreasing length, by classes of equal bins. Every bin class is then a range of sequence numbers,
and a piece finds its sequence from its number within its length, which two small aggregations give.

Null and empty texts are one piece with only the end token; equal rows are separate documents; an
empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textnp
from .common import SLICE_BYTES, cut, lean, table

CAPACITY = 2048
END_ID = 0
#: Slots for words whose ids a worker remembers (a power of two; 16 bytes each), and their ids altogether (4 bytes each) before it starts anew.
CACHE_WORDS = 1 << 21
CACHE_IDS = 8_000_000

Bin = tuple[tuple[tuple[int, int], ...], int]  # ((length, how often), ...), number of such bins


_SIGN = np.zeros(256, bool)
_SIGN[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = True
_SOLID = np.zeros(256, bool)
_SOLID[48:58] = _SOLID[65:91] = _SOLID[97:123] = True


def split_tails(w: textnp.Words) -> np.ndarray:
    """Parts words where a run of at most 8 signs ends them after an ASCII letter or digit; returns the documents' bounds over the parts.

    Left out are < > | of special strings and the apostrophe of contractions: words that end in those stay whole.
    """
    end = w.ends.copy()
    for _ in range(8):
        end -= _SIGN[w.buf[end - 1]] & (end - 1 > w.starts)
    cut = np.flatnonzero((end < w.ends) & _SOLID[w.buf[end - 1]])
    starts, ends = np.insert(w.starts, cut + 1, end[cut]), np.insert(w.ends, cut, end[cut])
    bounds = w.bounds + np.searchsorted(cut, w.bounds)
    w.starts, w.ends = starts, ends
    return bounds


class WordIds:
    """Token ids of whole texts through a cache of words.

    The tokenizer lower-cases, composes and splits at white space, so a text's ids are those
    of its words, one after the other; special strings have no white space in them. It also splits between a letter or digit
    and punctuation that ends the word, so both are looked up apart, in lower case. A 64-bit hash names a
    slot in the cache and is compared there; words that miss are tokenized once for the slice and take their slots.
    Of CACHE_WORDS words two share a hash with a probability of 1e-7.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(CACHE_WORDS, np.uint64)
        self.start, self.n = np.zeros(CACHE_WORDS, np.int32), np.zeros(CACHE_WORDS, np.int32)
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0

    def _ids(self, words: list[str]) -> list[tuple[list[int], np.ndarray]]:
        """(positions in words, their ids, how many each has) of all words, in parts.

        Words of letters alone are one unit to the tokenizer, whose last id is one of an end of unit; many of them are tokenized as one text.
        """
        plain = [k for k, x in enumerate(words) if x.isalpha() and (x.isascii() or (x.lower().isalpha() and is_normalized("NFC", x)))]
        out, left = [], sorted(set(range(len(words))).difference(plain))
        for i in range(0, len(plain), 256):
            part = plain[i : i + 256]
            ids = np.array(self.tokenizer.encode(" ".join([words[k] for k in part]), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                out.append((part, ids, np.diff(ends, prepend=0)))
            else:
                left += part
        if left:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([words[k] for k in left], add_special_tokens=False)]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            out.append((left, np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum())), n))
        return out

    def _add(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of the words begin, and how many they are."""
        start, n = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        for part, ids, size in self._ids(words):
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.empty_like(self.pool)))
            self.pool[self.used : self.used + len(ids)] = ids
            start[part], n[part] = self.used + np.cumsum(size) - size, size
            self.used += len(ids)
        return start, n

    def flat(self, docs: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, each with ``end`` after it, and the documents' bounds."""
        if self.used > CACHE_IDS:
            self.clear()
        w = textnp.Words(docs)
        bounds = split_tails(w)
        h = np.maximum(w.hashes(lower=True), np.uint64(1))
        slot = (h & np.uint64(CACHE_WORDS - 1)).astype(np.int64)
        start, n = self.start[slot].astype(np.int64), self.n[slot].astype(np.int64)
        miss = np.flatnonzero(self.known[slot] != h)
        if len(miss):
            u, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            f = miss[first]
            s, k = self._add([w.data[a:b].decode("utf-8", "replace") for a, b in zip(w.starts[f].tolist(), w.ends[f].tolist())])
            start[miss], n[miss] = s[inverse], k[inverse]
            self.known[slot[f]], self.start[slot[f]], self.n[slot[f]] = u, s, k
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + n, n)
        ids = self.pool[at]
        bounds = np.concatenate(([0], ends))[bounds]
        if end is not None:
            ids = np.insert(ids, bounds[1:], np.uint32(end))
            bounds = bounds + np.arange(len(bounds))
        return ids, bounds

    def encode(self, docs: list[bytes]) -> list[np.ndarray]:
        ids, bounds = self.flat(docs)
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


_coders: dict[str, WordIds] = {}


def coder(path: str) -> WordIds:
    """One to a worker process, so that its words last over tasks."""
    if path not in _coders:
        _coders[path] = WordIds(path)
    return _coders[path]


def numbered(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The number of each piece among those of its length, after those ``seen`` before, which are counted on."""
    order = np.argsort(length, kind="stable")
    x = length[order]
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    size = np.diff(np.append(first, len(x)))
    k = np.empty(len(x), np.int64)
    k[order] = np.arange(len(x)) - np.repeat(first, size) + seen[x]
    seen[x[first]] += size
    return k


def _pieces(path: str, capacity: int):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, part = coder(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            docs, keys = textnp.texts(batch.column("text")), batch.column("doc_id")
            for s in textnp.slices([len(d) for d in docs], SLICE_BYTES):
                ids, bounds = words.flat(docs[s], END_ID)
                n = np.diff(bounds)
                several = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), several)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(several) - several, several)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                data, at = memoryview(ids.astype("<u4").tobytes()), (bounds[:-1][doc] + start) * 4
                crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
                columns = [keys.slice(s.start, s.stop - s.start).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(numbered(length, seen))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and part and k: the piece is the k-th of its length in that partition."""
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(lean(_pieces(path, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, k long")


def knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Highest total price of a fill of every room, and the position of the piece length to place first (-1: none)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(lengths[0]), capacity + 1):
        fits = bisect.bisect_right(lengths, c)
        v = best[c - lengths[:fits]] + price[:fits]
        i = int(v.argmax())
        if v[i] >= best[c - 1]:
            best[c], pick[c] = v[i], i
        else:
            best[c] = best[c - 1]
    return best, pick


def fill(pick: np.ndarray, lengths: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        i = int(pick[room])
        if i < 0:
            room -= 1
            continue
        out.append(i)
        room -= int(lengths[i])
    return out


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 60, columns: int = 128, rate: float = 1.5, slack: float = 0.02) -> list[Bin]:
    """Bins that hold every piece of the histogram."""
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    covered = np.zeros(len(lengths))
    amount: dict[tuple[tuple[int, int], ...], float] = defaultdict(float)
    for _ in range(rounds):
        price = lengths / capacity * np.exp(-rate * (covered - covered.min()))
        best, pick = knapsack(lengths, price, capacity)
        value = price + best[capacity - lengths]
        good = np.flatnonzero(value >= (1 - slack) * value.max())
        forced = np.concatenate((good[np.argsort(covered[good], kind="stable")][:columns], np.argsort(covered, kind="stable")[: columns // 4]))
        for i in dict.fromkeys(forced.tolist()):
            items = np.bincount([i, *fill(pick, lengths, capacity - int(lengths[i]))], minlength=len(lengths))
            used = np.flatnonzero(items)
            step = float((counts[used] / items[used]).min()) / rounds * 4
            amount[tuple((int(j), int(items[j])) for j in used)] += step
            covered[used] += step * items[used] / counts[used]
    # Feasible: no length is used more often than it is there. Then whole numbers, down first, then up where pieces are left.
    left = counts.copy()
    whole: dict[tuple[tuple[int, int], ...], int] = defaultdict(int)
    scaled = {p: x / max(1.0, max(covered[j] for j, _ in p)) for p, x in amount.items()}
    for p, x in scaled.items():
        n = min(int(x), min(int(left[j]) // a for j, a in p))
        if n:
            whole[p] = n
            for j, a in p:
                left[j] -= n * a
    for p, x in sorted(scaled.items(), key=lambda kv: (-(kv[1] % 1), kv[0])):
        if x % 1 >= 0.3 and all(left[j] >= a for j, a in p):
            whole[p] += 1
            for j, a in p:
                left[j] -= a
    bins = [(tuple((int(lengths[j]), a) for j, a in p), n) for p, n in whole.items()]
    return best_fit(bins, {int(x): int(n) for x, n in zip(lengths, left) if n}, capacity)


def best_fit(bins: list[Bin], left: dict[int, int], capacity: int) -> list[Bin]:
    """Places what is left, longest first, each in the fullest bins with room for it; works on classes of equal bins."""
    room: dict[int, list[Bin]] = defaultdict(list)
    for items, n in bins:
        room[capacity - sum(x * a for x, a in items)].append((items, n))
    order = sorted(room)

    def put(items, n: int) -> None:
        free = capacity - sum(x * a for x, a in items)
        if free not in room or not room[free]:
            if free not in room:
                bisect.insort(order, free)
        room[free].append((items, n))

    for x in sorted(left, reverse=True):
        n = left[x]
        while n:
            at = bisect.bisect_left(order, x)
            if at == len(order):
                free, items, many = capacity, (), n
            else:
                free = order[at]
                items, many = room[free].pop()
                if not room[free]:
                    del room[free]
                    order.pop(at)
            each = min(free // x, n)
            used = min(many, n // each)
            put((*items, (x, each)), used)
            n -= used * each
            if items and many > used:
                put(items, many - used)
    return sorted((b for group in room.values() for b in group), reverse=True)


def slots(bins: list[Bin]) -> dict[int, np.ndarray]:
    """For each length rows (first number, first sequence, how often in a sequence, offset), sorted by first number."""
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    base = 0
    for items, n in bins:
        offset = 0
        for x, a in items:
            out[x].append((taken[x], base, a, offset))
            taken[x] += n * a
            offset += x * a
        base += n
    return {x: np.array(v, np.int64) for x, v in out.items()}


def _place(where: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, slot = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "slot"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                m = length == x
                t = where[x]
                r = t[np.searchsorted(t[:, 0], slot[m], "right") - 1]
                seq[m] = r[:, 1] + (slot[m] - r[:, 0]) // r[:, 2]
                off[m] = r[:, 3] + (slot[m] - r[:, 0]) % r[:, 2] * x
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = cut(pieces(docs, path, capacity))
    tallied = found.groupBy("length", "part").agg((F.max("k") + 1).alias("n"))
    histogram = {r.length: r.n for r in tallied.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    where = slots(solve(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = tallied.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = found.join(first, ["length", "part"]).withColumn("slot", F.col("first") + F.col("k"))
    return numbered.mapInArrow(lean(_place(where)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
