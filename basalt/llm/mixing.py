"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken ``target / source_size`` times. The whole part of that
ratio is granted at once; the fractional copy probability is rounded by the pivotal method. In
decreasing order of size each document meets the next smaller ones that are still fractional, in pairs: it
becomes integral, in a random direction with its own probability, and the words that it gains or gives move
between the two of each pair (``rounded``). So every pair keeps its expected words, every document has a
probability of its own, and a source misses its target by about its last and smallest documents.
Rounding runs per (source, bucket); the smallest documents of each bucket stay fractional and go on, with the words
that found no partner, to the next level of a reduction tree with FANIN buckets to a node, until one
node for each source is left.

A document too large for its partners is still taken with its own probability, and what they cannot make good
is residual. Two exceptions keep a source near its target: the last documents of a node, where shares equal in both
directions no longer suffice, may be drawn on unequally, which moves their probabilities a little; and in the
root of a source a document that outweighs all smaller fractional ones together is not drawn but decided by the target.

Random numbers are hashes of document ids, and buckets depend on ids and counts alone: reruns
and other partitionings give the same rows. Null and empty texts have size 0, take 0 words and are copied as often as the whole part says; null
sources form one source, the last; equal rows are separate documents; an empty table gives no
rows. Further columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2.0
#: Documents of a source to a bucket, about; buckets to a node of the tree.
BUCKET_DOCS = 4096
FANIN = 32
#: Share of a bucket's documents, its smallest, that stays fractional until the next level; and their least number.
RESERVE, LEAST_RESERVE = 1 / 16, 8
_NEAR = 1e-12


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source_key, source_size, n_docs, target: shares by weight, capped at ``most`` times the size, the excess reshared by weight.

    Resharing until no target is above its cap is the water level of the caps: in order of cap by
    weight, a source is capped exactly if the level that is left for it and those after it reaches its
    cap. One row for each source goes through the windows, never a document.
    """
    per = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    weight: Column = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(Window.orderBy(F.substring("source_key", 1, 1).desc(), "source_key")) - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy(F.lit(0))
    per = per.withColumns({"weight": weight, "cap": most * F.col("source_size")}).withColumns({"budget": share * F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every), "full_at": F.col("cap") / F.col("weight")})
    before = Window.orderBy("full_at", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("capped", F.col("full_at") <= F.col("level"))
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(every)
    return per.select("source_key", "source_size", "n_docs", F.when(F.col("capped"), F.col("cap")).otherwise(final * F.col("weight")).alias("target"))


def _unit(a: int, b: int, seed: int) -> float:
    """Uniform in [0, 1) from two ids."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x ^= x >> 31
        x = x * m & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 31)) / 2.0**64


def absorb(sizes: list[int], prob: list[float], extra: float) -> float:
    """Spreads residual words over fractional documents, by what each can both take and give, so that the sign of ``extra`` favours none; returns the rest."""
    room = [min(p, 1.0 - p) * s for p, s in zip(prob, sizes)]
    all_ = sum(room)
    if extra == 0.0 or all_ <= 0.0:
        return extra
    share = max(-1.0, min(1.0, extra / all_))
    for i, r in enumerate(room):
        if r > 0.0:
            prob[i] = _snap(prob[i] + share * r / sizes[i])
    return extra - share * all_


def _snap(p: float) -> float:
    return 0.0 if p < _NEAR else 1.0 if p > 1.0 - _NEAR else p


def rounded(ids: list[int], sizes: list[int], prob: list[float], reserve: int, seed: int, last: bool = False) -> float:
    """Makes all but the last ``reserve`` probabilities of a descending order of sizes integral, in place; returns the words that found no partner.

    A document a meets the next smaller fractional documents, pair by pair. Against b it may gain up to what b holds, or give
    up to what b has room for; pairs are added until their shares make a integral in either direction, and
    one draw of probability prob[a] decides the direction of all of them. Every share is the same in
    both directions, so no probability changes in expectation, and the expected words of each pair stay. Where the
    smaller documents are too few for that, what they cannot make good is residual, unless they hold enough for one direction and
    have room enough for the other: then they are drawn on to the full. At the ``last`` node nothing can take up a residual, so
    there a document too large for all smaller ones together goes in the direction that misses the target by less.
    """
    n, left = len(ids), 0.0
    open_ = [i for i in range(n) if 0.0 < prob[i] < 1.0]
    at = 0
    while at < len(open_):
        i = open_[at]
        at += 1
        p = prob[i]
        if i >= n - reserve:
            break
        if not 0.0 < p < 1.0:
            continue
        gain, give = (1.0 - p) * sizes[i], p * sizes[i]
        pairs, total = [], 0.0
        for k in range(at, len(open_)):
            j = open_[k]
            q = prob[j]
            if 0.0 < q < 1.0:
                w = min(q * sizes[j] / gain, (1.0 - q) * sizes[j] / give, 1.0 - total)
                pairs.append((j, w))
                total += w
                if total >= 1.0 - _NEAR:
                    break
        take = _unit(ids[i], i, seed) < p
        if total < 1.0 - _NEAR:
            holds = sum(prob[j] * sizes[j] for j, _ in pairs)
            room = sum(sizes[j] for j, _ in pairs) - holds
            whole = holds >= gain and room >= give
            if last and not whole:
                take = gain - holds < give - room
                whole = True
        prob[i] = 1.0 if take else 0.0
        words = -gain if take else give  # what the partners change by
        moved = 0.0
        for j, w in pairs:
            d = words * w
            prob[j] = _snap(prob[j] + d / sizes[j])
            moved += d
        if total < 1.0 - _NEAR:
            for j, _ in pairs if whole else ():
                q = prob[j]
                d = max(words - moved, -q * sizes[j]) if take else min(words - moved, (1.0 - q) * sizes[j])
                prob[j] = _snap(q + d / sizes[j])
                moved += d
            left += words - moved
    return left


def pivot(ids: list[int], sizes: list[int], mass: float, reserve: int, seed: int) -> tuple[list[float], float]:
    """``rounded`` from one common probability, mass / all sizes: (probabilities, words left over)."""
    rest = sum(sizes)
    p = _snap(min(1.0, max(0.0, mass / rest))) if rest else 0.0
    prob = [p if s else 0.0 for s in sizes]
    left = rounded(ids, sizes, prob, reserve, seed)
    return prob, left + mass - p * rest


def _round(level: int, last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["size", "doc_id", "row_key"], ascending=[False, True, True], kind="stable", na_position="last")
        ids = [0 if x is None or x != x else int(x) & 0x7FFFFFFFFFFFFFFF for x in g["doc_id"].astype(object)]
        sizes, prob = g["size"].tolist(), [_snap(p) for p in g["prob"].tolist()]
        reserve = 0 if last else min(len(g), max(LEAST_RESERVE, int(len(g) * RESERVE)))
        left = absorb(sizes, prob, float(g["extra"].sum()))
        left += rounded(ids, sizes, prob, reserve, level + 1, last)
        extra = [0.0] * len(g)
        if reserve:
            extra[-1] = left
        return g.assign(prob=prob, extra=extra, settled=[True] * (len(g) - reserve) + [False] * reserve)

    return run


def row_key(docs: DataFrame) -> Column:
    """Names a row by its id, source and text."""
    return F.xxhash64(*(docs[c] for c in ("doc_id", "source", "text")))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """doc_id, source, row_key, size, source_size, target, copies, taken: how often the mix takes each document; equal rows have equal row_keys."""
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    sizes = cut(docs.select("doc_id", key.alias("source_key"), row_key(docs).alias("row_key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    per = cut(targets(sizes, weights, share, most))
    most_docs = per.agg(F.max("n_docs")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(1, most_docs / BUCKET_DOCS), FANIN))) if most_docs > BUCKET_DOCS else 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + _NEAR)
    # Documents are dealt by (source, bucket), as the rounding is; a source has one row for each bucket that holds any of its documents.
    buckets = FANIN**levels
    sizes = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(buckets)).cast("int"))
    here = sizes.select("source_key", "bucket").distinct()
    spread = here.join(per.select("source_key", "source_size", "target"), "source_key")
    dealt = sizes.join(spread, ["source_key", "bucket"])
    live = dealt.withColumns({"whole": whole, "prob": F.when(F.col("size") > 0, F.greatest(F.lit(0.0), ratio - whole)).otherwise(F.lit(0.0)), "extra": F.lit(0.0), "settled": F.lit(False)})
    done = []
    for level in range(levels + 1):
        live = cut(live.groupBy("source_key", "bucket").applyInPandas(_round(level, level == levels), live.schema))
        done.append(live.filter("settled"))
        live = live.filter("NOT settled").withColumn("bucket", F.floor(F.col("bucket") / FANIN).cast("int"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = (F.col("whole") + F.col("prob")).cast("long")
    return out.select("doc_id", F.when(F.col("source_key") != "n", F.substring("source_key", 2, 2**31 - 1)).alias("source"), "row_key", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def copied(docs: DataFrame, **shares) -> DataFrame:
    """All columns of docs, each row as often as the mix takes it; rows equal in id, source and text share what is taken of them."""
    keyed = docs.withColumn("_row_key", row_key(docs))
    taken = cut(mix(docs, **shares).groupBy(F.col("row_key").alias("_row_key")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).filter("_copies > 0"))
    each = (F.col("_copies") / F.col("_rows")).cast("long")
    rest = F.col("_copies") % F.col("_rows")
    every = keyed.join(taken, "_row_key").withColumn("_times", each)
    uneven = keyed.join(taken.filter(rest > 0).withColumn("_times", rest).drop("_copies", "_rows"), "_row_key").dropDuplicates(["_row_key"])
    names = [F.col(f"`{c}`") for c in docs.columns]
    times = lambda df: df.filter("_times > 0").select(*names, F.explode(F.sequence(F.lit(1).cast("long"), "_times")).alias("_copy")).drop("_copy")
    return times(every).unionByName(times(uneven))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
