"""Types that follow the values: a fix point over flows between sites (variables, fields, results).

The value of a site is a set of types, each with the strength of what is known of it, or ``ANY`` once the set would hold more than ``most`` types.
Sets only grow and strengths only rise, so that the least fix point is unique, also on cycles. Each round joins what
the last one has changed with the flows (semi-naive), and what is known moves once; a site holds at most ``most`` rows, which bounds the state whatever the number of types that could reach it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import stored_by
from .graph import STRENGTH, strength

#: The type of a site that more types reach than are told apart.
ANY = "*"
MOST = 8


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _met(rows: DataFrame, most: int) -> DataFrame:
    """(site, type, s, fresh) of rows (site, type, had, got): one row ``ANY`` for sites of too many types; fresh is what was not known, or less well.

    One shuffle by site; all that follows stays within it.
    """
    w = Window.partitionBy("site")
    one = rows.repartition(_parts(rows), "site").groupBy("site", "type").agg(F.max("had").alias("had"), F.max("got").alias("got"))
    any_ = F.col("type") == ANY
    one = one.withColumns({"_many": (F.count("*").over(w) > most) | F.max(any_).over(w), "_was": F.max(any_ & F.col("had").isNotNull()).over(w), "_first": F.min("type").over(w) == F.col("type")})
    fresh = F.when(F.col("_many"), ~F.col("_was")).otherwise(F.col("had").isNull() | F.coalesce(F.col("got") > F.col("had"), F.lit(False)))
    return one.filter(~F.col("_many") | F.col("_first")).select("site", F.when(F.col("_many"), F.lit(ANY)).otherwise(F.col("type")).alias("type"), F.when(F.col("_many"), F.lit(0)).otherwise(F.greatest("had", "got")).alias("s"), fresh.alias("fresh"))


def propagate(origins: DataFrame, flows: DataFrame, most: int = MOST, rounds: int = 10_000) -> DataFrame:
    """(site, type, provenance): what reaches each site. origins: site, type, provenance; flows: src, dst.

    A site whose type is declared takes nothing from flows. What is propagated is inferred, or ambiguous if its origin is; of several ways the
    strongest counts. Null sites and types are left out; flows between sites without origin are allowed; equal rows count once.
    """
    start = origins.select("site", "type", strength(F.col("provenance")).alias("s")).filter("site IS NOT NULL AND type IS NOT NULL")
    declared = start.filter(F.col("s") == STRENGTH["declared"]).select(F.col("site").alias("dst")).distinct()
    # Flows and what is known lie in the same buckets of sites: they meet without a shuffle and are never broadcast.
    parts, none = _parts(origins), F.lit(None).cast("int")
    arcs = flows.select("src", "dst").filter("src <> dst").repartition(parts, "dst").distinct().join(declared.hint("merge"), "dst", "left_anti")
    arcs = stored_by(arcs.repartition(parts, "src"), parts, "src")
    known = stored_by(_met(start.select("site", "type", none.alias("had"), F.col("s").alias("got")), most), parts, "site")
    for _ in range(rounds):
        delta = known.filter("fresh").select("site", "type", "s")
        if delta.isEmpty():
            return known.select("site", "type", _provenance())
        came = delta.join(arcs, F.col("site") == F.col("src")).groupBy(F.col("dst").alias("site"), "type").agg(F.max(F.least("s", F.lit(STRENGTH["inferred"]))).alias("got"))
        known = stored_by(_met(known.select("site", "type", F.col("s").alias("had"), none.alias("got")).unionByName(came.withColumn("had", none)), most), parts, "site")
    raise RuntimeError(f"propagate: types still spread after {rounds} rounds")


def _provenance():
    out = F.lit("ambiguous")
    for name, n in STRENGTH.items():
        out = F.when(F.col("s") == n, F.lit(name)).otherwise(out)
    return out.alias("provenance")
