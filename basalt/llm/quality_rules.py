"""Quality rules: every rule is evaluated once into a bitmask ledger.

``ledger`` measures each whole text in one pass without a shuffle, and stores the measurements and
one failure bit for each rule. Policies are versioned masks over those bits; ``apply_policy`` and
``ablations`` never look at a text again.

Null and empty texts have no words and fail ``few_words``. Repeated rows and ties stay as they are,
one row out for each row in; an empty table gives an empty ledger. Columns of the input that clash
with a measurement are replaced in the output of ``ledger``; all others are dropped but ``doc_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnp
from .common import SLICE_BYTES, lean, table

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words")

#: name -> condition under which a text fails; the position is the bit.
RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "5 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "few_letters": "2 * n_letter_words < n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = ("few_words", "repeated_words")

#: Policies: version -> rules that reject.
POLICIES = {"base": BASE, "v1": (*BASE, "many_symbols", "duplicate_lines"), "v2": tuple(RULES)}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC3:] = True  # lead bytes of code points from U+00C0
_POINT = ~textnp.WS
_POINT[0x80:0xC0] = False


def _measure(docs: list[bytes]) -> np.ndarray:
    w = textnp.Words(docs)
    n = np.diff(w.bounds)
    doc = w.doc_of()

    def per_doc(flags: np.ndarray) -> np.ndarray:
        """Of flagged bytes, by document."""
        total = np.concatenate(([0], np.cumsum(flags)))
        at = np.concatenate(([1], 1 + np.cumsum([len(d) + 1 for d in docs])))
        return total[at[1:] - 1] - total[at[:-1]]

    letters = np.concatenate(([0], np.cumsum(_LETTER[w.buf])))
    lettered = np.bincount(doc[letters[w.ends] > letters[w.starts]], minlength=len(docs))
    at = textnp.inside(w.bounds, WINDOW)
    repeated = np.zeros(len(docs), np.int64)
    if len(at):
        h = textnp.windows(w.hashes(), WINDOW)[at] ^ textnp.mix(doc[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        repeated = np.bincount(doc[textnp.cover(at[twice], WINDOW, len(doc))], minlength=len(docs))
    lines = np.zeros((len(docs), 2), np.int64)
    for i, d in enumerate(docs):
        worded = [x for x in d.split(b"\n") if x and not x.isspace()]
        lines[i] = len(worded), len(worded) - len(set(worded))
    return np.stack([n, per_doc(_POINT[w.buf]), per_doc(_SYMBOL[w.buf]), lines[:, 1], repeated, lines[:, 0], lettered])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = textnp.texts(batch.column("text"))
        found = [_measure(docs[s]) for s in textnp.slices([len(d) for d in docs], SLICE_BYTES)]
        if found:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *map(pa.array, np.concatenate(found, axis=1).astype(np.int64))], names=["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and failed_bits: bit i is set when rule i of RULES rejects the text."""
    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(_measured), "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("failed_bits", total.cast("long"))


def mask(rules) -> int:
    return sum(BIT[r] for r in rules)


def apply_policy(led: DataFrame, policy: str = "v2") -> DataFrame:
    """Adds base_failed and kept under the policy's mask."""
    rejects = lambda m: F.col("failed_bits").bitwiseAND(F.lit(m)) != 0
    base = rejects(mask(BASE))
    return led.withColumns({"base_failed": base, "kept": ~base & ~rejects(mask(POLICIES[policy]))})


def ablations(led: DataFrame, policy: str = "v2") -> DataFrame:
    """For each rule: texts that it fails, texts that only it rejects under the policy, and texts kept without it.

    One map-side combined aggregation to at most 2**len(RULES) distinct masks, then bitwise tests on those.
    """
    m = mask(POLICIES[policy])
    masks = led.groupBy("failed_bits").agg(F.count("*").alias("n"))
    rules = masks.sparkSession.createDataFrame([(r, BIT[r]) for r in RULES], "rule string, bit long")
    hit = F.col("failed_bits").bitwiseAND(F.col("bit")) != 0
    rejected = F.col("failed_bits").bitwiseAND(F.lit(m))
    return (
        masks.join(F.broadcast(rules), F.lit(True))  # at most 2**7 masks by 7 rules
        .groupBy("rule")
        .agg(
            F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(rejected == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"),
            F.coalesce(F.sum(F.when(rejected.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n"))), F.lit(0)).alias("n_kept_without"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")


SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT doc_id, i, list_slice(w, i, i + 7) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM base WHERE len(w) >= 8)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c >= 2
), rep AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range(0, 8)) AS j FROM twice) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM base) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT b.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\x{C0}-\x{10FFFF}]')))::BIGINT AS n_letter_words
  FROM base b LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)
), bits AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 2 * n_letter_words < n_words THEN 64 ELSE 0 END)::BIGINT AS failed_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM bits
"""
