"""Corpus pipeline: documents in, packed token sequences out; every stage is one operator over all that its predecessor kept."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import jaccard_join, mixing, packing, suffix_dedup, toxicity
from basalt.llm.common import checkpoint_dir, remove, table, trim

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7, where the pooled threshold lies; thresholds by language are not used.

    Null and empty texts, null languages and null ids are scored like all others and stay when clean; equal rows share their fate.
    """
    return toxicity.annotate(docs, table(spark, sf_dir, "labels")).filter(F.col("predicted") == 0).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents linked by five-word shingles at a similarity of 0.8, the one of smallest id.

    Null ids and empty texts stay, all of them. Of rows that share an id, all stay or go, as the id does; equal ids are no copies of each other.
    """
    found = jaccard_join.join(docs, k=5, threshold=Fraction(4, 5))
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte strings that occur again, in other rows or the same one; all rows stay, null texts become empty."""
    return suffix_dedup.clean(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, at most twice; rows without words as often as the whole part of their source's ratio says, and null sources are one source."""
    return mixing.copied(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all copies in sequences of 2048 tokens; null and empty texts are one piece with the end alone."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Trained scores, random rounding and tokenization are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs.write.parquet(f"{place}/{name}")
            docs = spark.read.parquet(f"{place}/{name}")
            if before is not None:  # its successor is written; the last one feeds the result and stays with the checkpoints
                remove(spark, before)
            before = f"{place}/{name}"
            # What a stage held on the driver, by Python or by the checkpoints of its plans, goes before the next one.
            gc.collect()
            trim()
            spark._jvm.System.gc()
    return docs
