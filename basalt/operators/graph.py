"""Property graph as two tables: merging, trust, projection.

nodes: id, kind, file, ...; edges: src, dst, kind, provenance, weight, and optionally roles, alternatives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.session import dealt
from ..functions.text import segments

#: Provenances by strength, and the roles of an edge as bits.
STRENGTH = {"ambiguous": 0, "inferred": 1, "resolved": 2, "declared": 3}
ROLES = {"value": 1, "type": 2, "call": 4}
EDGE_KINDS = ("contains", "references", "calls", "extends", "implements", "mixes-in", "instantiates", "imports", "declares-type", "stores", "satisfies", "carries", "invokes-indirect", "affects")
CONSUMER_KINDS = ("references", "calls", "extends", "implements", "mixes-in", "instantiates", "imports", "declares-type", "carries")


def strength(provenance: Column) -> Column:
    out = F.lit(0)
    for name, n in STRENGTH.items():
        out = F.when(provenance == name, F.lit(n)).otherwise(out)
    return out


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge for (src, dst, kind): the strongest provenance replaces weaker ones; equals add weights, or roles and unite alternatives.

    One aggregation with sums by strength, over edges dealt by their ends and kind; the strongest is chosen afterwards.
    """
    s = strength(F.col("provenance"))
    has_roles, has_alt = "roles" in edges.columns, "alternatives" in edges.columns
    aggs = []
    for n in STRENGTH.values():
        aggs.append(F.sum(F.when(s == n, F.col("weight"))).cast("long").alias(f"_w{n}"))
        if has_roles:
            aggs.append(F.bit_or(F.when(s == n, F.col("roles"))).alias(f"_r{n}"))
        if has_alt:
            aggs.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(s == n, F.col("alternatives")))))).alias(f"_a{n}"))
    out = dealt(edges, "src", "dst", "kind").groupBy("src", "dst", "kind").agg(F.max(s).alias("_s"), *aggs)

    def pick(prefix: str) -> Column:
        c = F.col(f"{prefix}0")
        for n in (1, 2, 3):
            c = F.when(F.col("_s") == n, F.col(f"{prefix}{n}")).otherwise(c)
        return c

    name = F.element_at(F.array(*(F.lit(k) for k, _ in sorted(STRENGTH.items(), key=lambda x: x[1]))), (F.col("_s") + 1).cast("int"))
    return out.select("src", "dst", "kind", name.alias("provenance"), pick("_w").alias("weight"), *([pick("_r").alias("roles")] if has_roles else []), *([pick("_a").alias("alternatives")] if has_alt else []))


def trusted(edges: DataFrame, inferred: bool = True) -> DataFrame:
    """Edges that are not ambiguous, nor inferred if so asked."""
    return edges.filter(F.col("provenance").isin("declared", "resolved", *(["inferred"] if inferred else [])))


def has_role(role: str) -> Column:
    return F.col("roles").bitwiseAND(F.lit(ROLES[role])) != 0


def project(nodes: DataFrame, edges: DataFrame, key: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """src, dst, weight between the values of a node column (file, folder, ...): ambiguous and self edges drop, weights add."""
    e = trusted(edges)
    e = e.filter(F.col("kind").isin(*kinds)) if kinds else e.filter(~F.col("kind").isin("contains", "affects"))
    a, b = nodes.select(F.col("id").alias("src"), F.col(key).alias("_a")), nodes.select(F.col("id").alias("dst"), F.col(key).alias("_b"))
    return e.join(a, "src").join(b, "dst").filter(F.col("_a") != F.col("_b")).groupBy(F.col("_a").alias("src"), F.col("_b").alias("dst")).agg(F.sum("weight").cast("long").alias("weight"))


def topology_hash(projected: DataFrame) -> DataFrame:
    """One row: the SHA-1 of the sorted ``src dst weight`` lines, combined in a tree of 4096 hash buckets so that no task sees all edges."""
    line = F.concat_ws(" ", "src", "dst", F.col("weight").cast("string"))
    parts = projected.select(line.alias("l")).groupBy(F.pmod(F.crc32(F.col("l").cast("binary")), F.lit(4096)).alias("b")).agg(F.sha1(F.array_join(F.array_sort(F.collect_list("l")), "\n").cast("binary")).alias("h"))
    return parts.agg(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n").cast("binary")).alias("topology_hash"))


def degrees(projected: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, fan_in, fan_out: distinct neighbours in either direction; with nodes also those without edges."""
    both = projected.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(projected.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    if nodes is not None:
        both = both.unionByName(nodes.select("id", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return both.groupBy("id").agg(F.sum("i").cast("long").alias("fan_in"), F.sum("o").cast("long").alias("fan_out"))


def containment(files: DataFrame) -> DataFrame:
    """``contains`` edges folder -> folder -> file of a table with ``path``."""
    s = segments(F.col("path"))
    chain = F.concat(F.transform(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: F.concat(F.lit("folder:"), F.array_join(F.slice(s, 1, i), "/"))), F.array(F.concat(F.lit("file:"), F.col("path"))))
    chain = F.when(F.size(s) > 1, chain).otherwise(F.array(F.concat(F.lit("file:"), F.col("path"))))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(chain) - 1, F.lit(1))), lambda i: F.struct(F.get(chain, i - 1).alias("src"), F.get(chain, i).alias("dst")))
    return files.select(F.explode(pairs).alias("e")).select("e.*").filter(F.col("dst").isNotNull()).distinct().select("src", "dst", F.lit("contains").alias("kind"), F.lit("declared").alias("provenance"), F.lit(1).cast("long").alias("weight"))


def symbol_containment(symbols: DataFrame) -> DataFrame:
    """``contains`` edges file -> symbol, or type -> member where the container is a symbol of the file."""
    full = symbols.select("id", "file", F.array_join(F.concat("container", F.array("name")), ".").alias("path"), F.array_join("container", ".").alias("owner"))
    owners = full.groupBy("file", F.col("path").alias("owner")).agg(F.min("id").alias("owner_id"))
    j = full.filter("owner <> ''").join(owners, ["file", "owner"], "left").select("id", F.coalesce("owner_id", F.concat(F.lit("file:"), "file")).alias("src")).unionByName(full.filter("owner = ''").select("id", F.concat(F.lit("file:"), "file").alias("src")))
    return j.select("src", F.col("id").alias("dst"), F.lit("contains").alias("kind"), F.lit("declared").alias("provenance"), F.lit(1).cast("long").alias("weight"))


def attach_findings(findings: DataFrame, symbols: DataFrame) -> DataFrame:
    """``affects`` edges from finding:id to the symbol at its first place, else to the file."""
    s = symbols.select(F.col("file"), F.col("name").alias("symbol"), F.col("id").alias("_sym")).groupBy("file", "symbol").agg(F.min("_sym").alias("_sym"))
    return findings.join(s, ["file", "symbol"], "left").select(F.concat(F.lit("finding:"), "id").alias("src"), F.coalesce("_sym", F.concat(F.lit("file:"), "file")).alias("dst"), F.lit("affects").alias("kind"), F.lit("declared").alias("provenance"), F.lit(1).cast("long").alias("weight"))
