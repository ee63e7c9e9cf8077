"""Substring dedup: Rabin-Karp hashes of every window of ``width`` words, counted in Spark.

Each map task hashes all windows of its documents and sorts them by hash. A window that repeats within
the task's buffer is settled there; of every hash the first occurrence goes on to the reducer of its hash
range, as packed blocks. The reducer counts each hash over all blocks and returns every occurrence but the
first (smallest doc_id, then position). Window starts come together by document, and their union
is merged into maximal removal intervals. Occurrences are told equal by 72 hash bits: 64 of one hash of the
window, and 8 of a second hash over words that are hashed anew.

Group sizes do not matter: a window costs one packed entry in each buffer that has it, whatever its number
of copies, and hash ranges split a large group of copies evenly.

Null and empty texts, and those with fewer words than a window, lose nothing. A document is an id and a
text: rows that share an id and differ in text are told apart by a hash of the text, by which they sort after the id
(``_keyed``); of a window that several of them have, the first one in that order keeps it. Rows with the same id and text are one document: they are not
copies of each other and get equal results. Null doc_ids sort before all others, and -2**63 with them.
An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnp
from .common import SLICE_BYTES, cut, lean, shuffle_partitions, table
from .packed import pack, pack_sorted, range_cuts, unpack, unpack_sorted

WIDTH = 20
#: Bytes of text whose windows a map task sorts together.
BUFFER_BYTES = 6 << 20
NULL_ID = -(2**63)
_BLOCK = "range int, bucket int, hashes binary, checks binary, ids binary, rows binary, starts binary"
_SCHEMA = pa.schema([("range", pa.int32()), ("bucket", pa.int32())] + [(c, pa.binary()) for c in ("hashes", "checks", "ids", "rows", "starts")])


def _scatter(ids: np.ndarray, rows: np.ndarray, starts: np.ndarray, buckets: int) -> list[tuple]:
    """(bucket of the document, packed ids, rows and starts) with one entry for each bucket that has any."""
    bucket = (textnp.mix(textnp.mix(ids.view(np.uint64) + np.uint64(3)) ^ rows.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((starts, rows, ids, bucket))
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(b, pack(ids[order[x:y]]), pack(rows[order[x:y]]), pack(starts[order[x:y]])) for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if y > x]


def _windows(keys: np.ndarray, docs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, check byte, number of the document and start of every window."""
    hashes, checks, ids, starts = [], [], [], []
    for s in textnp.slices([len(d) for d in docs], SLICE_BYTES):
        w = textnp.Words(docs[s])
        at = textnp.inside(w.bounds, width)
        doc = np.searchsorted(w.bounds, at, "right") - 1
        words = w.hashes()
        hashes.append(textnp.windows(words, width)[at] if len(at) else np.empty(0, np.uint64))
        second = textnp.windows(textnp.mix(words ^ np.uint64(0x2545F4914F6CDD1D)), width)[at] if len(at) else np.empty(0, np.uint64)
        checks.append((second & np.uint64(255)).astype(np.uint8))
        ids.append(keys[s][doc])
        starts.append((at - w.bounds[doc]).astype(np.int32))
    return np.concatenate(hashes), np.concatenate(checks), np.concatenate(ids), np.concatenate(starts)


def _blocks(width: int, ranges: int):
    def flush(held: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda x: x[:2])  # stable sorts by hash then keep (doc_id, row, start) order
        of_id, of_row = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
        h, checks, doc, starts = _windows(np.arange(len(held)), [x[2] for x in held], width)
        order = np.argsort(h, kind="stable")
        h, checks, doc, starts = h[order], checks[order], doc[order], starts[order]
        ids, own = of_id[doc], of_row[doc]
        # Where windows of one hash differ, what follows a change goes on, and the reducer settles it.
        first = np.concatenate(([True], (h[1:] != h[:-1]) | (checks[1:] != checks[:-1]))) if len(h) else np.empty(0, bool)
        origin = np.flatnonzero(first)[np.cumsum(first) - 1] if len(h) else first
        later = ~first & ((ids != ids[origin]) | (own != own[origin]) | (starts != starts[origin]))
        rows = [(b, b, None, None, *packed) for b, *packed in _scatter(ids[later], own[later], starts[later], ranges)]
        h, checks, ids, own, starts = h[first], checks[first], ids[first], own[first], starts[first]
        cuts = range_cuts(h, ranges)
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            s = slice(cuts[r], cuts[r + 1])
            rows.append((r, None, pack_sorted(h[s]), checks[s].tobytes(), pack(ids[s]), pack(own[s]), pack(starts[s])))
        for i in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 4096]), _SCHEMA)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            own = b.column("row").to_pylist() if "row" in b.schema.names else [0] * len(b)
            for k, row, d in zip(b.column("doc_id").to_pylist(), own, textnp.texts(b.column("text"))):
                held.append((NULL_ID if k is None else k, row, d))
                size += len(d)
                if size >= BUFFER_BYTES:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _later(ranges: int):
    """Of one hash range: every occurrence of a hash but the first, packed by bucket of documents."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        local = group[group["hashes"].isna()]
        out = list(zip(local["bucket"].astype(int), local["ids"], local["rows"], local["starts"]))
        blocks = group[group["hashes"].notna()]
        if len(blocks):
            h = np.concatenate([unpack_sorted(x) for x in blocks["hashes"]])
            check = np.concatenate([np.frombuffer(x, np.uint8) for x in blocks["checks"]])
            ids, own = (np.concatenate([unpack(x, np.int64) for x in blocks[c]]) for c in ("ids", "rows"))
            starts = np.concatenate([unpack(x, np.int32) for x in blocks["starts"]])
            order = np.argsort(h, kind="stable")
            same = h[order[1:]] == h[order[:-1]]
            many = np.zeros(len(h), bool)
            many[order[1:][same]] = many[order[:-1][same]] = True
            at = np.flatnonzero(many)
            at = at[np.lexsort((starts[at], own[at], ids[at], check[at], h[at]))]
            if len(at):
                first = np.concatenate(([True], (h[at[1:]] != h[at[:-1]]) | (check[at[1:]] != check[at[:-1]])))
                origin = at[np.flatnonzero(first)[np.cumsum(first) - 1]]
                keep = at[(ids[at] != ids[origin]) | (own[at] != own[origin]) | (starts[at] != starts[origin])]
                out += _scatter(ids[keep], own[keep], starts[keep], ranges)
        return pd.DataFrame(out, columns=["bucket", "ids", "rows", "starts"])

    return run


def _by_document(group: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: the documents, each with its starts as int32 bytes, ascending."""
    ids, own = (np.concatenate([unpack(x, np.int64) for x in group[c]]) for c in ("ids", "rows"))
    starts = np.concatenate([unpack(x, np.int32) for x in group["starts"]])
    order = np.lexsort((starts, own, ids))
    ids, own, data = ids[order], own[order], starts[order].astype("<i4").tobytes()
    at = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (own[1:] != own[:-1]))))
    return pd.DataFrame({"doc_id": ids[at], "row": own[at], "starts": [data[4 * x : 4 * y] for x, y in zip(at.tolist(), np.append(at[1:], len(ids)).tolist())]})


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, row: a hash of the text where rows of different texts share the id, else 0."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    key = F.coalesce("doc_id", F.lit(NULL_ID))
    shared = cut(docs.select(key.alias("key"), h.alias("h")).groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("key"))
    if shared.isEmpty():  # ids are unique, or rows that share one are equal
        return docs.withColumn("row", F.lit(0).cast("long"))
    return docs.withColumn("key", key).join(shared.withColumn("shared", F.lit(True)), "key", "left").select("doc_id", "text", F.when(F.col("shared"), h).otherwise(F.lit(0)).cast("long").alias("row"))


def repeated_starts(docs: DataFrame, width: int = WIDTH, ranges: int | None = None) -> DataFrame:
    """doc_id, row, starts (int32 bytes): starts of windows whose words also start earlier; one row to a document that has any. docs come from ``_keyed``."""
    ranges = ranges or shuffle_partitions(docs.sparkSession)
    blocks = docs.mapInArrow(lean(_blocks(width, ranges)), _BLOCK)
    found = cut(blocks.groupBy("range").applyInPandas(_later(ranges), "bucket int, ids binary, rows binary, starts binary"))
    return found.groupBy("bucket").applyInPandas(_by_document, "doc_id long, row long, starts binary")


def intervals(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Maximal removal intervals [from, to) of the windows at these starts."""
    gone = textnp.cover(starts, width, n).view(np.int8)
    edge = np.diff(np.concatenate(([0], gone, [0])))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)


def _removed(width: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, starts, keys = textnp.texts(b.column("text")), b.column("starts").to_pylist(), b.column("doc_id")
            for s in textnp.slices([len(d) for d in docs], SLICE_BYTES):
                rows = []
                for text, at in zip(docs[s], starts[s]):
                    words, gone = text.split(), 0
                    n = len(words)
                    if at:
                        left, end = [], 0
                        for x, y in intervals(np.frombuffer(at, "<i4"), width, n).tolist():
                            left += words[end:x]
                            end, gone = y, gone + y - x
                        words = left + words[end:]
                    kept = b" ".join(words)
                    rows.append((n, gone, kept.decode("utf-8", "replace") if keep_text else None, hashlib.sha256(kept).hexdigest()))
                n, gone, kept, digest = zip(*rows)
                yield pa.RecordBatch.from_arrays([keys.slice(s.start, s.stop - s.start), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return run


def dedup(docs: DataFrame, width: int = WIDTH, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (null unless asked for), kept_sha256."""
    keyed = _keyed(docs)
    starts = repeated_starts(keyed, width).withColumnsRenamed({"doc_id": "key", "row": "key_row"})
    same = (F.coalesce(F.col("doc_id"), F.lit(NULL_ID)) == F.col("key")) & (F.col("row") == F.col("key_row"))
    joined = keyed.join(starts, same, "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(lean(_removed(width, keep_text)), "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + 19) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(g, ' ')) ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, 20)) AS j FROM later)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
