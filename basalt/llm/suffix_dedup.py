"""Suffix-array dedup by distributed prefix doubling over a content-defined subset of the positions.

Wanted are all positions whose ``length``-byte prefix (200) also starts at another position. Suffixes are sorted at
anchors only: the positions of the least 8-byte string in any WINDOW consecutive positions, which are the same
wherever the same bytes stand. Bytes between two anchors are a phrase. With a string of 200 bytes that starts at a
position go the anchor of the position's own window and all phrases within SPAN bytes after it, so
equal strings have equal phrases there.

Doubling. The first ranks are those of two phrases; round r pairs each anchor's rank with the rank at an offset
of 2**r anchors (less, where SPAN ends before), Spark sorts the pairs, and equal neighbours get one new
rank, which then stands for up to 2**(r+1) phrases. Anchors whose pair is unique are dropped, and so are
those whose partner was; rounds go on until no anchor is left that is not past its span.

Threshold. Two last sorts settle the bytes. The positions of an anchor are a run of neighbours: runs of
one rank are sorted by the name of all their bytes, and equal ones are repeated as a whole. Where a rank has different
runs, one run of each name lists its positions with the pair (100 bytes here, 100 bytes at offset 100);
equal pairs are equal 200-byte prefixes, which is the threshold.

Input rows are gathered once into blocks of a few MB, stored with all their columns; an anchor or position is known
as (block, number in the block), so that rows need no ids. Within a block equal pairs are found locally, and two of
them at most are sent, so a group of copies of any size costs a sort at most two rows for each block.
Ranks of the rounds are exact; the two phrases of the first ranks and whole runs are told apart by 64-bit names,
pairs at the end by 128 bits.

Null and empty texts, and those shorter than the threshold, lose nothing. Every row is a text of its own, whatever
its doc_id: equal rows are copies of each other, and null or repeated doc_ids change nothing. An empty table gives no
rows. Other columns are ignored by ``dedup`` and kept by ``clean``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnp
from .common import SLICE_BYTES, checkpoint_dir, dropping_shuffles, lean, remove, shuffle_partitions, table
from .packed import pack, unpack

LENGTH = 200
WINDOW, GRAM = 40, 8
BLOCK_BYTES = 4 << 20
#: Rows of a sort to a partition, about, where the shuffle partitions of the session would hold more.
SORT_ROWS = 4_000_000
#: Blocks to a partition, about, likewise; a task's blocks may be in memory at once.
TASK_BLOCKS = 6
#: Answers that a sorting task holds before it passes them on.
HELD = 400_000
_NUMBER = 30  # bits of the number within a block
_STATE = "block long, n int, bounds binary, pos binary, back binary, counts binary, ranks binary"
_ENTRY = "k1 long, k2 long, id long"
_ANSWER = "block long, ids binary, values binary"


def span_of(length: int) -> int:
    """Bytes after an anchor whose phrases every ``length``-byte string with that anchor determines."""
    return length - 2 * WINDOW - GRAM + 2


def anchors(docs: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(document, position, first position of its run less that, positions of its run, name of two phrases or 0) of every anchor of texts of ``length`` bytes or more."""
    size = np.array([len(d) for d in docs], np.int64)
    begin = np.cumsum(size) - size
    data = b"".join(docs) + bytes(GRAM)
    n, long = int(size.sum()), np.flatnonzero(size >= length)
    if not len(long):
        return (*(np.empty(0, np.int64) for _ in range(4)), np.empty(0, np.uint64))
    grams = np.ndarray((n,), "<u8", data, 0, (1,))
    low = textnp.mix(grams) >> np.uint64(32) << np.uint64(32) | np.arange(n, dtype=np.uint64)  # least string, then leftmost
    m = 1
    while 2 * m <= WINDOW:
        low = np.minimum(low[:-m], low[m:])
        m *= 2
    if m < WINDOW:
        low = np.minimum(low[: len(low) - (WINDOW - m)], low[WINDOW - m :])
    inside = np.zeros(n + 1, np.int8)
    np.add.at(inside, begin[long], 1)
    np.add.at(inside, begin[long] + size[long] - (WINDOW + GRAM - 2), -1)
    start = np.flatnonzero(np.cumsum(inside[: len(low)], dtype=np.int8))
    least = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    at, own = least[first], start[first]
    doc = np.searchsorted(begin, at, "right") - 1
    doc = long[np.searchsorted(long, doc)] if len(long) < len(docs) else doc
    end = begin[doc] + size[doc]
    following = np.append(start[first[1:]], n)
    # A run ends where the next anchor takes over, or where a string of the length would leave the text.
    until = np.minimum(np.where(np.append(doc[1:] != doc[:-1], True), end, following), end - length + 1)
    total, q = textnp.prefix_sums(np.frombuffer(data, np.uint8)[:n])
    names = np.zeros(len(at), np.uint64)
    two = np.flatnonzero(doc[2:] == doc[:-2])
    names[two] = np.maximum(textnp.span(total, q, at[two], at[two + 2]), np.uint64(1))
    return doc, at - begin[doc], at - own, np.maximum(until - own, 0), names


def _ipc(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _rows(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about BLOCK_BYTES of text."""
    held, size, block = [], 0, TaskContext.get().partitionId() << 13

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([_ipc(pa.Table.from_batches(held))])], names=["block", "rows"])

    for b in batches:
        sizes = [x.as_py() or 0 for x in pa.compute.binary_length(b.column("text"))]
        for s in textnp.slices(sizes, BLOCK_BYTES):
            held.append(b.slice(s.start, s.stop - s.start))
            size += sum(sizes[s])
            if size >= BLOCK_BYTES:
                yield flush()
                held, size, block = [], 0, block + 1
    if held:
        yield flush()


def _parsed(length: int):
    """Anchors of every block, ranked by the names of two phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _dicts(batches):
            docs, parts, before = textnp.texts(_rows(row["rows"]).column("text")), [], 0
            for s in textnp.slices([len(d) for d in docs], SLICE_BYTES):
                doc, *rest = anchors(docs[s], length)
                parts.append((doc + before, *rest))
                before += s.stop - s.start
            doc, pos, back, counts, names = (np.concatenate(x) for x in zip(*parts))
            bounds = np.searchsorted(doc, np.arange(len(docs) + 1))
            yield _state_row(row["block"], bounds, pos, back.astype(np.uint8), counts.astype(np.uint8), names)

    return run


def _state_row(block: int, bounds, pos, back, counts, ranks) -> pa.RecordBatch:
    data = [pack(x) for x in (bounds.astype(np.int32), pos.astype(np.int32), back, counts, ranks)]
    return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([len(pos)], pa.int32()), *(pa.array([x]) for x in data)], names=["block", "n", "bounds", "pos", "back", "counts", "ranks"])


class State:
    """The anchors of a block; ranks are 0 for those that were dropped."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.bounds, self.pos = unpack(row["bounds"], np.int32), unpack(row["pos"], np.int32).astype(np.int64)
        self.back, self.counts = unpack(row["back"], np.uint8), unpack(row["counts"], np.uint8)
        self.ranks = unpack(row["ranks"], np.uint64)

    def pairs(self, covered: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors that go into the round after ranks of ``covered`` phrases, with their pairs of ranks; drops those whose partner is."""
        live = np.flatnonzero(self.ranks)
        if covered == 0:  # the first ranks are names of two phrases
            return live, self.ranks[live], np.zeros(len(live), np.uint64)
        doc = np.searchsorted(self.bounds, live, "right") - 1
        # Phrases within the span: positions are made ascending over documents.
        every = self.pos + (np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds)) << 33)
        most = np.searchsorted(every, self.pos[live] + (doc << 33) + span, "right") - 1 - live
        some = live[most > covered]
        other = some + np.minimum(covered, most[most > covered] - covered)
        partner = self.ranks[other]
        self.ranks = self.ranks.copy()
        mine = self.ranks[some]
        self.ranks[some[partner == 0]] = 0
        go = partner > 0
        return some[go], mine[go], partner[go]

    def row(self) -> pa.RecordBatch:
        return _state_row(self.block, self.bounds, self.pos, self.back, self.counts, self.ranks)


def _equal(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (k1, k2), and where in it another pair begins."""
    order = np.lexsort((k2, k1)) if k2.any() else np.argsort(k1, kind="stable")
    a, b = k1[order], k2[order]
    return order, np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.empty(0, bool)


def _sent(block: int, numbers: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Entries of a block: the first two of equal ones."""
    order, new = _equal(k1, k2)
    if len(order):
        two = new | np.concatenate(([False], new[:-1]))
        at = order[two]
        ids = (np.int64(block) << _NUMBER) | numbers[at].astype(np.int64)
        for s in range(0, len(at), 100_000):
            e = slice(s, s + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(k1[at[e]].view(np.int64)), pa.array(k2[at[e]].view(np.int64)), pa.array(ids[e])], names=["k1", "k2", "id"])


def _spread(numbers: np.ndarray, k1: np.ndarray, k2: np.ndarray, ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Answers to the entries of a block, for all its anchors or positions: (numbers that got one, values)."""
    order, new = _equal(k1, k2)
    if not len(order) or not len(ids):
        return np.empty(0, np.int64), np.empty(0, values.dtype)
    group = np.cumsum(new) - 1
    first = numbers[order[new]]
    by = np.argsort(ids)
    ids, values = ids[by], values[by]
    at = np.minimum(np.searchsorted(ids, first), len(ids) - 1)
    hit = ids[at] == first
    got = hit[group]
    return numbers[order[got]], values[at][group[got]]


class _Answers:
    """Packs (id, value) by block."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, ids: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((ids, values))
        self.n += len(ids)
        if self.n >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            ids, values = (np.concatenate(x) for x in zip(*self.parts))
            order = np.argsort(ids, kind="stable")
            ids, values = ids[order], values[order]
            block, number = ids >> _NUMBER, (ids & ((1 << _NUMBER) - 1)).astype(np.int32)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(ids)]))
            rows = [(int(block[a]), pack(number[a:b]), pack(values[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            for i in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 2000])], names=["block", "ids", "values"])
        self.parts, self.n = [], 0


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "id"))


def _reranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted pairs: the new rank of every entry whose pair another one has, which is the first one's id plus one."""
    out, carry, told = _Answers(), None, False
    for b in batches:
        k1, k2, ids = _columns(b)
        if not len(ids):
            continue
        if carry is not None:
            k1, k2, ids = (np.concatenate(([c], x)) for c, x in zip(carry, (k1, k2, ids)))
        new = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(ids)))
        repeated = np.repeat(size > 1, size)
        rank = np.repeat(ids[at], size) + 1
        if carry is not None and told:
            repeated[0] = False
        yield from out.add(ids[repeated], rank[repeated])
        told = bool(size[-1] > 1) or (told and carry is not None and len(at) == 1)
        carry = k1[at[-1]], k2[at[-1]], ids[at[-1]]
    yield from out.flush()


WHOLE, ASK = 1, 2


def _runs_told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over runs sorted by (rank, name): WHOLE for runs that are repeated as a whole; ASK for the first run of each name where a rank has several."""
    out, held = _Answers(), []

    def tell(k1, k2, ids) -> Iterator[pa.RecordBatch]:
        new_rank = np.concatenate(([True], k1[1:] != k1[:-1]))
        new = new_rank | np.concatenate(([True], k2[1:] != k2[:-1]))
        g, r = np.cumsum(new) - 1, np.cumsum(new_rank) - 1
        flag = np.where((np.bincount(g) > 1)[g], WHOLE, 0) | np.where(new & (np.bincount(r, new) > 1)[r], ASK, 0)
        some = flag > 0
        yield from out.add(ids[some], flag[some].astype(np.int64))

    for b in batches:
        part = _columns(b)
        if not len(part[0]):
            continue
        last = int(np.searchsorted(-(part[0] != part[0][-1]).astype(np.int8), 0))  # where the batch's last rank begins
        if held and held[-1][0][-1] != part[0][0]:
            yield from tell(*(np.concatenate(x) for x in zip(*held)))
            held = []
        if last:
            held.append(tuple(x[:last] for x in part))
            yield from tell(*(np.concatenate(x) for x in zip(*held)))
            held = []
        held.append(tuple(x[last:] for x in part))
    if held:
        yield from tell(*(np.concatenate(x) for x in zip(*held)))
    yield from out.flush()


def _dicts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {c: b.column(c)[i].as_py() for c in b.schema.names}


def _answers(row: dict, dtype) -> tuple[np.ndarray, np.ndarray]:
    found = row.get("answers") or []
    if not found:
        return np.empty(0, np.int64), np.empty(0, dtype)
    return np.concatenate([unpack(x["ids"], np.int32) for x in found]).astype(np.int64), np.concatenate([unpack(x["values"], np.int64) for x in found]).astype(dtype)


def _round_entries(covered: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _dicts(batches):
            state = State(row)
            yield from _sent(state.block, *state.pairs(covered, span))

    return run


def _round_merged(covered: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _dicts(batches):
            state = State(row)
            some, k1, k2 = state.pairs(covered, span)
            state.ranks[some] = 0
            got, rank = _spread(some, k1, k2, *_answers(row, np.uint64))
            state.ranks[got] = rank
            yield state.row()

    return run


def _runs(state: State, docs: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Live anchors with a run, their ranks, and the names of their runs."""
    live = np.flatnonzero((state.ranks > 0) & (state.counts > 0))
    doc = np.searchsorted(state.bounds, live, "right") - 1
    names, first = np.empty(len(live), np.uint64), state.pos[live] - state.back[live]
    for s in textnp.slices([len(d) for d in docs], SLICE_BYTES):
        a, b = np.searchsorted(doc, [s.start, s.stop])
        if a < b:
            size = np.array([len(d) for d in docs[s]], np.int64)
            begin = np.cumsum(size) - size
            total, q = textnp.prefix_sums(np.frombuffer(b"".join(docs[s]), np.uint8))
            x = begin[doc[a:b] - s.start] + first[a:b]
            names[a:b] = textnp.span(total, q, x, x + state.counts[live[a:b]] + length - 1)
    return live, state.ranks[live], names


def _run_entries(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _dicts(batches):
            state = State(row)
            live, rank, name = _runs(state, textnp.texts(_rows(row["rows"]).column("text")), length)
            yield from _sent(state.block, live, rank, name)

    return run


def _listed(docs: list[bytes], doc: np.ndarray, first: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, position, 128 bits of the pair of halves there) of every position of some runs."""
    half, out = length // 2, []
    for s in textnp.slices([len(d) for d in docs], SLICE_BYTES):
        a, b = np.searchsorted(doc, [s.start, s.stop])
        if a < b:
            size = np.array([len(d) for d in docs[s]], np.int64)
            begin = np.cumsum(size) - size
            total, q = textnp.prefix_sums(np.frombuffer(b"".join(docs[s]), np.uint8))
            n = counts[a:b].astype(np.int64)
            ends = np.cumsum(n)
            pos = np.repeat(first[a:b] - ends + n, n) + np.arange(ends[-1])
            of = np.repeat(doc[a:b], n)
            at = begin[of - s.start] + pos
            out.append((of, pos, textnp.span(total, q, at, at + half), textnp.span(total, q, at + half, at + length)))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _runs_merged(length: int):
    """State after the runs: spans of positions that are repeated, and the positions asked for with their pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _dicts(batches):
            state, docs = State(row), textnp.texts(_rows(row["rows"]).column("text"))
            live, rank, name = _runs(state, docs, length)
            numbers, flags = _answers(row, np.int64)
            whole = np.zeros(len(state.pos), bool)
            got, told = _spread(live, rank, name, numbers, flags)
            whole[got[(told & WHOLE) > 0]] = True
            spans = np.flatnonzero(whole)
            ask = np.sort(numbers[(flags & ASK) > 0])
            doc = lambda x: np.searchsorted(state.bounds, x, "right") - 1
            first = state.pos - state.back
            listed = _listed(docs, doc(ask), first[ask], state.counts[ask], length)
            data = [doc(spans).astype(np.int32), first[spans].astype(np.int32), state.counts[spans].astype(np.int32), listed[0].astype(np.int32), listed[1].astype(np.int32), listed[2], listed[3]]
            yield pa.RecordBatch.from_arrays([pa.array([state.block]), *(pa.array([pack(x)]) for x in data)], names=["block", "docs", "firsts", "counts", "ask_docs", "ask_at", "k1", "k2"])

    return run


def _position_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _dicts(batches):
        k1, k2 = unpack(row["k1"], np.uint64), unpack(row["k2"], np.uint64)
        yield from _sent(row["block"], np.arange(len(k1)), k1, k2)


def _positions_merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated positions of every block: (document, first, count), by document."""
    for row in _dicts(batches):
        doc, first, count = (unpack(row[c], np.int32) for c in ("docs", "firsts", "counts"))
        k1, k2 = unpack(row["k1"], np.uint64), unpack(row["k2"], np.uint64)
        more = np.sort(_spread(np.arange(len(k1)), k1, k2, *_answers(row, np.int64))[0])
        doc = np.concatenate((doc, unpack(row["ask_docs"], np.int32)[more]))
        first = np.concatenate((first, unpack(row["ask_at"], np.int32)[more]))
        count = np.concatenate((count, np.ones(len(more), np.int32)))
        order = np.lexsort((first, doc))
        yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), *(pa.array([pack(x[order])]) for x in (doc, first, count))], names=["block", "docs", "firsts", "counts"])


def _spans(row: dict, n_docs: int) -> list[np.ndarray]:
    """For each document of a block its (first, count) of repeated positions."""
    doc, first, count = (unpack(row[c], np.int32) for c in ("docs", "firsts", "counts"))
    cuts = np.searchsorted(doc, np.arange(n_docs + 1))
    pairs = np.stack([first, count], 1).astype(np.int64)
    return [pairs[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


class _Store:
    """Tables written in the shared folder, each deleted when no later step reads it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.place, self.n = spark, f"{checkpoint_dir(spark)}/suffixes-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.place}/{self.n}"
        self.n += 1
        with dropping_shuffles(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        remove(self.spark, path)


class _Deal:
    """How many partitions blocks and entries are dealt over, from their numbers."""

    def __init__(self, state: DataFrame):
        count = state.agg(F.count("*").alias("blocks"), F.sum("n").alias("rows")).first()
        least = shuffle_partitions(state.sparkSession)
        self.blocks, self.rows = max(least, -(-count.blocks // TASK_BLOCKS)), max(least, -(-(count.rows or 0) // SORT_ROWS))

    def by_block(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.blocks, "block")


def _answered(state: DataFrame, entries: DataFrame, tell: Callable, deal: _Deal, by_first: bool = False) -> DataFrame:
    """Sorts entries by their pairs, and joins what ``tell`` says of them to the blocks, which are dealt by block."""
    keys = ["k1"] if by_first else ["k1", "k2"]
    sorted_ = entries.repartition(deal.rows, *keys).sortWithinPartitions("k1", "k2", "id")
    told = deal.by_block(sorted_.mapInArrow(lean(tell), _ANSWER)).groupBy("block").agg(F.collect_list(F.struct("ids", "values")).alias("answers"))
    return state.join(told, "block", "left")


def found(docs: DataFrame, store: _Store, length: int = LENGTH) -> DataFrame:
    """block, rows (the input, by block) and its spans of repeated positions: docs, firsts, counts."""
    span = span_of(length)
    texts, _ = store.put(docs.mapInArrow(lean(_blocks), "block long, rows binary"))
    state, path = store.put(texts.mapInArrow(lean(_parsed(length)), _STATE))
    deal, covered = _Deal(state), 0
    while covered == 0 or not state.mapInArrow(lean(_round_entries(covered, span)), _ENTRY).isEmpty():
        entries = state.mapInArrow(lean(_round_entries(covered, span)), _ENTRY)
        merged, new = store.put(_answered(deal.by_block(state), entries, _reranked, deal).mapInArrow(lean(_round_merged(covered, span)), _STATE))
        store.drop(path)
        state, path, covered = merged, new, 2 * covered or 2
    whole = deal.by_block(texts).join(deal.by_block(state), "block")
    told = _answered(whole, whole.mapInArrow(lean(_run_entries(length)), _ENTRY), _runs_told, deal, by_first=True)
    asked, new = store.put(told.mapInArrow(lean(_runs_merged(length)), "block long, docs binary, firsts binary, counts binary, ask_docs binary, ask_at binary, k1 binary, k2 binary"))
    store.drop(path)
    told = _answered(deal.by_block(asked), asked.mapInArrow(lean(_position_entries), _ENTRY), _reranked, deal)
    spans, _ = store.put(told.mapInArrow(lean(_positions_merged), "block long, docs binary, firsts binary, counts binary"))
    store.drop(new)
    return deal.by_block(texts).join(deal.by_block(spans), "block")


def removal(spans: np.ndarray, length: int, n: int) -> np.ndarray:
    """Maximal removed byte runs [from, to)."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, spans[:, 0], 1)
    np.add.at(d, np.minimum(spans[:, 0] + spans[:, 1] + length - 1, n), -1)
    gone = (np.cumsum(d[:-1]) > 0).view(np.int8)
    edge = np.diff(np.concatenate(([0], gone, [0])))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)


def _cut(text: bytes, spans: np.ndarray, length: int) -> tuple[bytes, int]:
    """What is left of a text, and the number of its removed runs."""
    if not len(spans):
        return text, 0
    out = removal(spans, length, len(text))
    cuts = [0, *out.ravel().tolist(), len(text)]
    return b"".join(text[x:y] for x, y in zip(cuts[::2], cuts[1::2])), len(out)


def _removed(length: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _dicts(batches):
            t = _rows(row["rows"])
            rows = []
            for text, spans in zip(textnp.texts(t.column("text")), _spans(row, t.num_rows)):
                kept, k = _cut(text, spans, length)
                rows.append((len(text), len(text) - len(kept), k, kept if keep else None, hashlib.sha256(kept).hexdigest()))
            n, gone, k, kept, digest = zip(*rows)
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(k, pa.int64()), pa.array(kept, pa.binary()), pa.array(digest)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return run


def dedup(docs: DataFrame, length: int = LENGTH, keep: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes; null unless asked for), kept_sha256."""
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return found(cols, _Store(docs.sparkSession), length).mapInArrow(lean(_removed(length, keep)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def _cut_texts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _dicts(batches):
            t = _rows(row["rows"])
            left = [_cut(text, spans, length)[0].decode("utf-8", "ignore") for text, spans in zip(textnp.texts(t.column("text")), _spans(row, t.num_rows))]
            yield from t.set_column(t.schema.get_field_index("text"), "text", pa.array(left, pa.string())).combine_chunks().to_batches()

    return run


def clean(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes cut from ``text``; code points that a cut parts are dropped, null texts become empty."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    return found(docs, _Store(docs.sparkSession), length).mapInArrow(lean(_cut_texts(length)), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), keep=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
