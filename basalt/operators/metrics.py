"""The six graph metrics over projected edges (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut
from .communities import louvain
from .components import components
from .graph import degrees

__all__ = ["clustering", "connected_components", "crosses_folders", "instability", "louvain", "pagerank", "scc", "vertices"]

#: Fixed values of the metrics.
DAMPING, TOLERANCE, MOST_ITERATIONS = 0.85, 1e-6, 100


def vertices(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    found = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return (found if nodes is None else found.unionByName(nodes.select("id"))).distinct()


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, iterations: int | None = None) -> DataFrame:
    """id, pagerank, fan_in, fan_out: weighted, uniform teleport, dangling mass spread evenly; stops when the L1 change is below n * 1e-6.

    With ``iterations`` it runs exactly that often. The loop moves one number per vertex; the driver sees two sums a round.
    """
    v = cut(vertices(edges, nodes))
    n = v.count()
    if n == 0:
        return v.select("id", F.lit(0.0).alias("pagerank"), F.lit(0).cast("long").alias("fan_in"), F.lit(0).cast("long").alias("fan_out"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("_total"))
    share = cut(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_total")).alias("share")))
    rank = cut(v.join(out.select(F.col("src").alias("id"), F.lit(False).alias("dangling")), "id", "left").select("id", F.coalesce("dangling", F.lit(True)).alias("dangling"), F.lit(1.0 / n).alias("r")))
    for _ in range(iterations or MOST_ITERATIONS):
        lost = rank.filter("dangling").agg(F.coalesce(F.sum("r"), F.lit(0.0))).first()[0]
        got = share.join(rank.select(F.col("id").alias("src"), "r"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("r")).alias("got"))
        new = cut(rank.join(got, "id", "left").select("id", "dangling", "r", (F.lit((1 - DAMPING) / n) + DAMPING * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / n))).alias("new")))
        change = new.agg(F.sum(F.abs(F.col("new") - F.col("r")))).first()[0]
        rank = new.select("id", "dangling", F.col("new").alias("r"))
        if iterations is None and change < n * TOLERANCE:
            break
    return rank.select("id", F.col("r").alias("pagerank")).join(degrees(edges, v), "id")


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, component (the smallest id), for isolated vertices too."""
    v = vertices(edges, nodes)
    found = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return v.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _reach(label: DataFrame, edges: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Propagates the largest label along edges until nothing changes."""
    while True:
        pushed = edges.join(label.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "label")
        new = cut(label.unionByName(pushed).groupBy("id").agg(F.max("label").alias("label")))
        if new.join(label.withColumnRenamed("label", "old"), "id").filter("label <> old").isEmpty():
            return new
        label = new


def scc(edges: DataFrame) -> DataFrame:
    """id, component (the smallest member), size of the strongly connected components of two and more.

    Colouring: the largest id reaching a vertex colours it; within a colour, whatever reaches the root backwards is its component. Rounds
    end when no edge is left; every round settles at least the component of every colour.
    """
    left = cut(edges.filter("src <> dst").select("src", "dst").distinct())
    found: DataFrame | None = None
    while True:
        # Vertices without edges in both directions are alone.
        while True:
            trimmed = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            same = trimmed.count() == left.count()
            left = trimmed
            if same:
                break
        if left.isEmpty():
            break
        colour = _reach(vertices(left).withColumn("label", F.col("id")), left)
        inner = cut(left.join(colour.select(F.col("id").alias("src"), F.col("label").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("label").alias("cd")), "dst").filter("cs = cd").select("src", "dst"))
        roots = cut(colour.filter("id = label").select("id", "label"))
        back = roots
        while True:
            more = inner.select(F.col("dst").alias("id"), F.col("src").alias("up")).join(back, "id").select(F.col("up").alias("id"), "label")
            new = cut(back.unionByName(more).distinct())
            if new.count() == back.count():
                break
            back = new
        found = back if found is None else cut(found.unionByName(back))
        gone = back.select("id")
        left = cut(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
    if found is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component"), F.lit(0).cast("long").alias("size")).limit(0)
    sizes = found.groupBy("label").agg(F.min("id").alias("component"), F.count("*").alias("size")).filter("size >= 2")
    return found.join(sizes, "label").select("id", "component", "size")


def crosses_folders(members: DataFrame, folders: DataFrame) -> DataFrame:
    """component, size, crosses_folder: whether its members (id, component, size) lie in several folders (id, folder)."""
    return members.join(folders, "id").groupBy("component").agg(F.max("size").alias("size"), (F.min("folder") != F.max("folder")).alias("crosses_folder"))


def instability(edges: DataFrame) -> DataFrame:
    """id, ca, ce, instability = ce / (ca + ce) over distinct neighbours; without any, the vertex is not in the edges."""
    d = degrees(edges.select("src", "dst").distinct())
    return d.select("id", F.col("fan_in").alias("ca"), F.col("fan_out").alias("ce"), (F.col("fan_out") / (F.col("fan_in") + F.col("fan_out"))).alias("instability"))


def clustering(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, degree, triangles, clustering: undirected local coefficient, 0 below two neighbours.

    Edges point from the lower to the higher degree, so that a hub has few outgoing wedges and triangles are found once.
    """
    und = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()
    deg = und.select(F.col("a").alias("id")).unionByName(und.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    da, db = deg.select(F.col("id").alias("a"), F.col("degree").alias("da")), deg.select(F.col("id").alias("b"), F.col("degree").alias("db"))
    up = F.struct("da", "a") < F.struct("db", "b")
    directed = cut(und.join(da, "a").join(db, "b").select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("hi"), F.when(up, F.col("db")).otherwise(F.col("da")).alias("dh")))
    x, y = directed.select("lo", F.col("hi").alias("m"), F.col("dh").alias("dm")), directed.select("lo", F.col("hi").alias("t"), F.col("dh").alias("dt"))
    wedges = x.join(y, "lo").filter(F.struct("dm", "m") < F.struct("dt", "t"))
    tri = wedges.join(directed.select(F.col("lo").alias("m"), F.col("hi").alias("t")), ["m", "t"]).select(F.explode(F.array("lo", "m", "t")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    v = deg if nodes is None else nodes.select("id").distinct().join(deg, "id", "left")
    k = F.coalesce("degree", F.lit(0))
    t = F.coalesce("triangles", F.lit(0))
    return v.join(tri, "id", "left").select("id", k.cast("long").alias("degree"), t.cast("long").alias("triangles"), F.when(k < 2, F.lit(0.0)).otherwise(2.0 * t / (k * (k - 1))).alias("clustering"))
