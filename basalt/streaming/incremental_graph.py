"""The reference graph kept up to date under edits: facts by name, edges retracted and added, partitions replaced.

A reference meets only symbols of its own name, and an edge leads to a symbol of the name that was referred to. So symbols, references,
decided edges and merged edges are stored in the same buckets of names, and a bucket never needs another one. An update takes the
facts that an edit removes and adds (the cache has both by content), finds the names whose declarations differ, resolves again the references
of those names and of the edit, and writes the buckets that it touched under a new version. Last it writes which
version each bucket has; what fails before that leaves the graph as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import discard, dropping_shuffles, stored
from ..operators import graph, resolve

BUCKETS = 64
TABLES = ("symbols", "references", "decided", "merged")
SYMBOL = ("id", "file", "name", "container", "family", "exported", "member_of_class_like")
REFERENCE = ("ref_id", "from_id", *resolve.CONTEXT)


def _bucket(name: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


class Graph:
    """A stored graph below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets

    def heads(self) -> dict[int, str]:
        """The version of each bucket: at most ``buckets`` rows of the last commit."""
        commits = self.spark.read.parquet(f"{self.root}/commits")
        last = commits.agg(F.max("n")).first()[0]
        return {r.bucket: r.version for r in commits.filter(F.col("n") == last).collect()} | {-1: str(last)}

    def table(self, name: str, heads: dict[int, str] | None = None, only: list[int] | None = None) -> DataFrame:
        """Rows of a table, of the buckets asked for; other buckets are not read."""
        heads = heads if heads is not None else self.heads()
        by: dict[str, list[int]] = {}
        for b, v in heads.items():
            if b >= 0 and (only is None or b in only):
                by.setdefault(v, []).append(b)
        out = None
        for v, found in by.items():
            part = self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.root}/{v}/{name}").filter(F.col("bucket").isin(found))
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], _SCHEMAS[name])

    def edges(self) -> DataFrame:
        """src, dst, kind, provenance, weight."""
        return self.table("merged").drop("bucket")

    def _commit(self, tables: dict[str, DataFrame], heads: dict[int, str], touched: list[int], n: int) -> None:
        version = f"v{n}-{uuid.uuid4().hex[:8]}"
        with dropping_shuffles(self.spark):
            for name, df in tables.items():
                df.repartition("bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/{version}/{name}")
        new = {b: v for b, v in heads.items() if b >= 0} | dict.fromkeys(touched, version)
        self.spark.createDataFrame([(n, b, v) for b, v in new.items()] or [(n, -2, version)], "n int, bucket int, version string").coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def build(self, symbols: DataFrame, references: DataFrame) -> None:
        """The whole graph anew."""
        s, r = stored(self._placed(symbols, SYMBOL)), stored(self._placed(references, REFERENCE))
        decided = stored(self._decided(r, s))
        self._commit({"symbols": s, "references": r, "decided": decided, "merged": self._merged(decided)}, {}, list(range(self.buckets)), 0)
        discard(s, r, decided)

    def update(self, removed_symbols: DataFrame, added_symbols: DataFrame, removed_references: DataFrame, added_references: DataFrame) -> list[int]:
        """Facts that go and that come; a fact that changes does both. The buckets that were written."""
        heads = self.heads()
        s0, s1 = (stored(self._placed(x, SYMBOL)) for x in (removed_symbols, added_symbols))
        r0, r1 = (stored(self._placed(x, REFERENCE)) for x in (removed_references, added_references))
        dirty = stored(s0.exceptAll(s1).unionByName(s1.exceptAll(s0)).select("bucket", "name").distinct())
        touched = sorted(r[0] for r in dirty.select("bucket").unionByName(r0.select("bucket")).unionByName(r1.select("bucket")).distinct().collect())  # at most ``buckets``
        if not touched:
            return []
        old = {t: self.table(t, heads, touched) for t in TABLES}
        # Rows are told apart by all their columns: of an edit that removes and adds the same row, one stays.
        symbols = stored(old["symbols"].exceptAll(s0.filter(F.col("bucket").isin(touched))).unionByName(s1.filter(F.col("bucket").isin(touched))))
        gone = r0.select("ref_id").distinct()
        kept = old["references"].join(gone, "ref_id", "left_anti").select(*REFERENCE, "bucket")
        references = stored(kept.unionByName(r1).dropDuplicates(["ref_id"]))
        names = dirty.select("name")
        again = references.join(names, "name", "left_semi").unionByName(references.join(r1.select("ref_id").distinct(), "ref_id", "left_semi")).dropDuplicates(["ref_id"])
        again = stored(again)
        new = self._decided(again, symbols.join(again.select("name").distinct(), "name", "left_semi"))
        decided = old["decided"].join(gone.unionByName(again.select("ref_id")).distinct(), "ref_id", "left_anti").unionByName(new)
        decided = stored(decided)
        self._commit({"symbols": symbols, "references": references, "decided": decided, "merged": self._merged(decided)}, heads, touched, int(heads[-1]) + 1)
        discard(s0, s1, r0, r1, dirty, symbols, references, again, decided)
        return touched

    def _placed(self, df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        return df.select(*columns).withColumn("bucket", _bucket(F.col("name"), self.buckets))

    def _decided(self, references: DataFrame, symbols: DataFrame) -> DataFrame:
        return resolve.decisions(references, symbols).withColumn("bucket", _bucket(F.col("name"), self.buckets)).select("ref_id", "src", "dst", "kind", "provenance", "weight", "bucket")

    def _merged(self, decided: DataFrame) -> DataFrame:
        """Edges of one (src, dst, kind) are in one bucket, that of their destination's name."""
        at = decided.groupBy("src", "dst", "kind").agg(F.min("bucket").alias("bucket"))
        return graph.merge_edges(decided.select("src", "dst", "kind", "provenance", "weight")).join(at, ["src", "dst", "kind"]).select("src", "dst", "kind", "provenance", "weight", "bucket")


_EDGE = "src string, dst string, kind string, provenance string, weight long, bucket int"
_SCHEMAS = {
    "symbols": "id string, file string, name string, container array<string>, family string, exported boolean, member_of_class_like boolean, bucket int",
    "references": "ref_id string, from_id string, file string, name string, role string, scope array<string>, qualifier string, qualifier_is_bare_constant boolean, shadowed_locally boolean, is_callee boolean, in_type_slot boolean, bucket int",
    "decided": f"ref_id string, {_EDGE}",
    "merged": _EDGE,
}
