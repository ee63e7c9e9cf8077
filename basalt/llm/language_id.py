"""Language identification by multinomial naive Bayes over hashed character n-grams.

Text is lower-cased, everything but letters becomes a word border, and the one, two and three letters long n-grams of
words with their borders are hashed into ``BUCKETS`` cells. Training counts cells by language in numpy, Spark adds the
counts of all partitions, and one packed vector of log probabilities to a language comes to the driver and is broadcast as a
matrix. Scoring is one pass over the texts without a shuffle: a batch of texts is one sparse list of cells, summed
by text for each language in turn.

``lang`` is read for training only, from the rows that ``learn`` marks; ids and sources are never read by the model.
Scores are posterior probabilities of the predicted language (class priors are shares of training texts).

Null texts and texts without a letter are ``und`` with score 0.0 and teach nothing. So is every text if no language was learnt.
Null languages teach nothing; an empty string is a language like others. Ties go to the least language. Repeated rows
are learnt and scored each. Very long texts are read whole. An empty table gives no rows. The matrix is bounded by ``MOST_LANGUAGES``; a column
with more values raises an error, as it does not hold languages. Other columns of the input stay; those called ``lang_pred`` and ``score`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnp
from .common import SLICE_BYTES, lean, table

BITS = 16
BUCKETS = 1 << BITS
MOST_LANGUAGES = 512
#: Added to every count.
SMOOTH = 0.1
UNKNOWN = "und"
_KEYS = np.random.default_rng(20250311).integers(1, 2**63, (3, 4), dtype=np.int64).astype(np.uint64) | np.uint64(1)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def cells(docs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts and, for each, the number of its text, ascending."""
    lowered = [(d or "").lower() for d in docs]
    code = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[code]
    keep = letter.copy()
    keep[:-1] |= letter[1:]  # of what lies between words the last character is their border
    keep[-1] = True
    doc = np.repeat(np.arange(len(docs) + 1), [*(len(t) + 1 for t in lowered), 1])[keep]
    code, letter = np.where(letter, code, 32)[keep].astype(np.uint64), letter[keep]
    owner = np.where(letter, doc, np.append(doc[1:], doc[-1]))  # a border belongs to the word after it
    found, of = [], []
    for n in (1, 2, 3):
        m = len(code) - n + 1
        if m <= 0:
            continue
        ok = letter[:m] if n == 1 else letter[1 : m + 1] if n == 3 else letter[:m] | letter[1 : m + 1]
        h = np.full(m, _KEYS[n - 1, 3])
        for i in range(n):
            h += code[i : m + i] * _KEYS[n - 1, i]
        found.append((h[ok] >> np.uint64(64 - BITS)).astype(np.int64))
        of.append(owner[:m][ok])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return h[order], of[order]


def _strings(column: pa.Array) -> Iterator[tuple[slice, list[str | None]]]:
    docs = column.to_pylist()
    for s in textnp.slices([len(d or "") for d in docs], SLICE_BYTES):
        yield s, docs[s]


def _parts(docs: list[str | None]) -> Iterator[tuple[list[str | None], np.ndarray]]:
    """The texts and their numbers; a text of more than SLICE_BYTES characters comes in pieces, cut at a border of words where there is one."""
    if len(docs) != 1 or len(docs[0] or "") <= SLICE_BYTES:
        yield docs, np.arange(len(docs))
        return
    text, at = docs[0], 0
    while at < len(text):
        end = min(len(text), at + SLICE_BYTES)
        cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end)) + 1 if end < len(text) else end
        end = cut if cut > at else end
        yield [text[at:end]], np.zeros(1, np.int64)
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, cell, n) of one partition; cell -1 counts the texts."""
    held: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array((at - 1).astype(np.int32)), pa.array(counts[at])], names=["lang", "cell", "n"])
        held.clear()

    for b in batches:
        langs = b.column("lang").to_pylist()
        for s, docs in _strings(b.column("text")):
            names = sorted(set(langs[s]))
            which = np.array([names.index(x) for x in langs[s]])
            seen = np.zeros(len(docs), bool)
            for part, owner in _parts(docs):
                h, of = cells(part)
                by = which[owner[of]]
                seen[owner[of]] = True
                for i in np.unique(by).tolist():
                    counts = held.setdefault(names[i], np.zeros(BUCKETS + 1, np.int64))
                    counts[1:] += np.bincount(h[by == i], minlength=BUCKETS)
            for i, n in enumerate(np.bincount(which[seen], minlength=len(names)).tolist()):
                if n:
                    held[names[i]][0] += n
            if len(held) > 64:
                yield from flush()
    yield from flush()


def _column(group: pd.DataFrame) -> pd.DataFrame:
    """One language: its texts and log probabilities, packed. A group has at most BUCKETS + 1 rows."""
    n = np.zeros(BUCKETS + 1)
    n[group["cell"].to_numpy() + 1] = group["n"].to_numpy()
    p = np.log((n[1:] + SMOOTH) / (n[1:].sum() + SMOOTH * BUCKETS)).astype("<f4")
    return pd.DataFrame({"lang": [group["lang"].iloc[0]], "texts": [int(n[0])], "logs": [p.tobytes()]})


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray
    logs: np.ndarray

    def predict(self, docs: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its posterior probability."""
        pred, score = [UNKNOWN] * len(docs), np.zeros(len(docs))
        if not self.langs:
            return pred, score
        sums, seen = np.zeros((len(docs), len(self.langs))), np.zeros(len(docs), bool)
        for part, owner in _parts(docs):
            h, of = cells(part)
            if len(h):
                some, start = np.unique(of, return_index=True)
                np.add.at(sums, owner[some], np.stack([np.add.reduceat(row[h], start, dtype=np.float64) for row in self.logs], 1))
                seen[owner[some]] = True
        some = np.flatnonzero(seen)
        total = sums[some] + self.prior
        best = total.argmax(1)
        score[some] = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        for d, k in zip(some.tolist(), best.tolist()):
            pred[d] = self.langs[k]
        return pred, score


def fit(docs: DataFrame, learn: Column | None = None) -> Model:
    """Counts over every row of docs (lang, text) that ``learn`` marks."""
    rows = docs.filter(learn) if learn is not None else docs
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(lean(_counted), "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    found = counts.groupBy("lang").applyInPandas(_column, "lang string, texts long, logs binary").filter("texts > 0").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    found.sort(key=lambda r: r.lang)
    texts = np.array([r.texts for r in found], float)
    logs = np.stack([np.frombuffer(r.logs, "<f4") for r in found]) if found else np.empty((0, BUCKETS), np.float32)
    return Model([r.lang for r in found], np.log(texts / texts.sum()) if found else texts, logs)


def annotate(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs with lang_pred and score."""
    added = {"lang_pred": "string", "score": "double"}
    docs = docs.withColumn("text", F.col("text").cast("string")).drop(*added)
    names = docs.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"{k} {v}" for k, v in added.items()])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            pred: list[str] = []
            score = []
            for _, part in _strings(b.column("text")):
                p, s = m.predict(part)
                pred += p
                score.append(s)
            if pred:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(pred), pa.array(np.concatenate(score))], names=[*names, *added])

    return docs.mapInArrow(lean(run), schema)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for null ids."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    model = fit(docs, ~held_out(F.col("doc_id")))
    out = annotate(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
