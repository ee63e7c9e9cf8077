"""Connected components of an edge table by alternating large and small stars, each round checkpointed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut

ROUNDS = 60


def _large(e: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the smallest of u and its neighbours."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small(e: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the smallest of them; e has a > b."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    return e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of comparable ids -> (id, component): the smallest id reachable, for every id on an edge."""
    order = lambda e: e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e, seen = cut(order(edges)), None
    for _ in range(ROUNDS):
        e = cut(_small(order(_large(e))).distinct())
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: stars still changed after {ROUNDS} rounds")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
