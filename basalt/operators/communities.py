"""Communities by modularity on the whole graph (Louvain), as rounds of joins.

All vertices weigh their moves at once: links to each neighbouring community, its total and the weight of the whole graph give
the gain of a move. A round moves one of two classes of vertices, by a hash of the id and the round, so that neighbours rarely swap. Where
modularity does not rise by that, of adjacent vertices only the one with the higher gain goes (the smaller id of equals), and where it
still does not, only moves that touch no community twice, whose gains are exact. So modularity rises with every round. When nothing moves, communities become
the vertices of the next level. A round moves one row for a vertex and its neighbouring communities; no task holds a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut

#: Rounds of a level, levels, least gain.
MOST_PASSES, MOST_LEVELS, GAIN = 100, 20, 1e-12


def _both(edges: DataFrame) -> DataFrame:
    """src, dst, w: undirected weights in both directions, without loops."""
    e = edges.filter("src <> dst").select("src", "dst", F.col("weight").cast("double").alias("w"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def modularity(edges: DataFrame, communities: DataFrame) -> float:
    """Modularity at resolution 1 of (id, community) over undirected edges (src, dst, weight); loops do not count."""
    e = _both(edges)
    k = e.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    return _quality(e, k.join(communities.select("id", F.col("community").alias("com")), "id"), e.agg(F.sum("w")).first()[0] or 0.0, 0.0)


def _quality(e: DataFrame, state: DataFrame, m2: float, loops: float) -> float:
    if not m2:
        return 0.0
    at = state.select("id", "com")
    inside = e.join(at.withColumnRenamed("id", "src").withColumnRenamed("com", "a"), "src").join(at.withColumnRenamed("id", "dst").withColumnRenamed("com", "b"), "dst").filter("a = b").agg(F.sum("w")).first()[0] or 0.0
    spread = state.groupBy("com").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0] or 0.0
    return (inside + loops) / m2 - spread / (m2 * m2)


def _wishes(e: DataFrame, state: DataFrame, m2: float) -> DataFrame:
    """id, com, to, gain: the best move of every vertex that gains by one; the least community of equals."""
    links = e.join(state.select(F.col("id").alias("dst"), F.col("com").alias("to")), "dst").groupBy(F.col("src").alias("id"), "to").agg(F.sum("w").alias("w"))
    total = state.groupBy(F.col("com").alias("to")).agg(F.sum("k").alias("t"))
    # The own community is weighed without the vertex itself, whether it has links there or not.
    own = state.select("id", F.col("com").alias("to"), F.lit(0.0).alias("w"))
    every = links.unionByName(own).groupBy("id", "to").agg(F.sum("w").alias("w")).join(total, "to").join(state, "id")
    here = F.col("to") == F.col("com")
    gain = F.col("w") - F.col("k") * (F.col("t") - F.when(here, F.col("k")).otherwise(0.0)) / m2
    best = every.withColumn("g", gain).groupBy("id", "com").agg(F.min(F.when(~here, F.struct((-F.col("g")).alias("g"), "to"))).alias("b"), F.max(F.when(here, F.col("g"))).alias("stay"))
    return best.select("id", "com", F.col("b.to").alias("to"), (-F.col("b.g") - F.col("stay")).alias("gain")).filter(F.col("gain") > GAIN)


def _apart(e: DataFrame, wishes: DataFrame) -> DataFrame:
    """Wishes of vertices that no adjacent vertex with a greater one has."""
    mine = e.select("src", "dst").join(wishes.select(F.col("id").alias("src"), F.col("gain").alias("g")), "src").join(wishes.select(F.col("id").alias("dst"), F.col("gain").alias("h")), "dst")
    lost = mine.filter((F.col("h") > F.col("g")) | ((F.col("h") == F.col("g")) & (F.col("dst") < F.col("src")))).select(F.col("src").alias("id")).distinct()
    return wishes.join(lost, "id", "left_anti")


def _alone(wishes: DataFrame) -> DataFrame:
    """Wishes whose two communities no greater wish touches."""
    rank = F.struct((-F.col("gain")).alias("g"), "id")
    touched = wishes.select(F.explode(F.array("com", "to")).alias("c"), rank.alias("r")).groupBy("c").agg(F.min("r").alias("first"))
    first = lambda c: touched.select(F.col("c").alias(c), F.col("first").alias(f"_{c}"))
    return wishes.join(first("com"), "com").join(first("to"), "to").filter((F.col("_com") == rank) & (F.col("_to") == rank)).drop("_com", "_to")


def louvain(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, community (its smallest id) over undirected edges (src, dst, weight); vertices without edges are their own. Loops do not count."""
    found = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    member = cut((found if nodes is None else found.unionByName(nodes.select("id"))).distinct().withColumn("com", F.col("id")))
    e = cut(_both(edges))
    m2 = e.agg(F.sum("w")).first()[0] or 0.0
    loops = 0.0
    state = cut(e.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")).withColumn("com", F.col("id")))
    for _ in range(MOST_LEVELS if m2 else 0):
        quality, moved = _quality(e, state, m2, loops), False
        for turn in range(MOST_PASSES):
            wishes = cut(_wishes(e, state, m2))
            if wishes.isEmpty():
                break
            half = lambda w, turn=turn: w.filter(F.pmod(F.xxhash64("id", F.lit(turn // 2)), F.lit(2)) == turn % 2)
            for pick in (half, lambda w: _apart(e, w), _alone):
                go = pick(wishes).select("id", "to")
                new = cut(state.join(go, "id", "left").select("id", "k", F.coalesce("to", "com").alias("com")))
                now = _quality(e, new, m2, loops)
                if now > quality:
                    break
            else:
                break  # what is left is rounding
            state, quality, moved = new, now, True
        if not moved:
            break
        # A community is called by its least vertex, and is a vertex of the next level.
        names = state.groupBy("com").agg(F.min("id").alias("name"))
        at = cut(state.join(names, "com").select("id", F.col("name").alias("com"), "k"))
        member = cut(member.join(at.select(F.col("id").alias("com"), F.col("com").alias("up")), "com", "left").select("id", F.coalesce("up", "com").alias("com")))
        joined = e.join(at.select(F.col("id").alias("src"), F.col("com").alias("a")), "src").join(at.select(F.col("id").alias("dst"), F.col("com").alias("b")), "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))
        joined = cut(joined)
        loops += joined.filter("src = dst").agg(F.sum("w")).first()[0] or 0.0
        e = cut(joined.filter("src <> dst"))
        state = cut(at.groupBy(F.col("com").alias("id")).agg(F.sum("k").alias("k")).withColumn("com", F.col("id")))
        if e.isEmpty():
            break
    least = member.groupBy("com").agg(F.min("id").alias("community"))
    return member.join(least, "com").select("id", "community")
