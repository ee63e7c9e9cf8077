"""Fact cache as Parquet partitioned by repository: read, upsert, decisions, collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the collection.
TTL_DAYS, MOST_ROWS, MOST_BYTES = 14, 200_000, 500 * 1000 * 1000
KEY = ["repo_key", "file_path"]


def hits(facts: DataFrame, files: DataFrame, version: str) -> DataFrame:
    """Cached rows of files whose content and analyzer version are the same."""
    return facts.filter(F.col("analyzer_version") == version).join(files.select(*KEY, "content_hash").distinct(), [*KEY, "content_hash"], "left_semi")


def misses(facts: DataFrame, files: DataFrame, version: str) -> DataFrame:
    return files.join(facts.filter(F.col("analyzer_version") == version).select(*KEY, "content_hash"), [*KEY, "content_hash"], "left_anti")


def upsert(facts: DataFrame, new: DataFrame) -> DataFrame:
    """Latest row for each key and version; the new one wins ties."""
    k = F.row_number().over(Window.partitionBy(*KEY, "analyzer_version").orderBy(F.col("last_used_at").desc(), F.col("_new").desc()))
    both = facts.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_k", k).filter("_k = 1").drop("_k", "_new")


def collect_garbage(facts: DataFrame, version: str, now, rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, days: int = TTL_DAYS) -> DataFrame:
    """Rows that stay: of this version, used in time, among the latest ``rows``, while their running sum of bytes fits.

    Ranks and running sums come from day totals first: only the days around either limit are ordered row by row.
    """
    live = facts.filter((F.col("analyzer_version") == version) & (F.col("last_used_at") >= F.lit(now) - F.expr(f"INTERVAL {days} DAYS"))).withColumn("_day", F.to_date("last_used_at"))
    per = live.groupBy("_day").agg(F.count("*").alias("_c"), F.sum("bytes").alias("_b"))
    before = Window.orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, -1)  # at most TTL_DAYS + 1 rows
    base = per.select("_day", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c0"), F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"))
    w = Window.partitionBy("_day").orderBy(F.col("last_used_at").desc(), *KEY).rowsBetween(Window.unboundedPreceding, 0)
    j = live.join(F.broadcast(base), "_day").filter((F.col("_c0") < rows) & (F.col("_b0") <= most_bytes))
    j = j.withColumns({"_n": F.col("_c0") + F.count("*").over(w), "_s": F.col("_b0") + F.sum("bytes").over(w)})
    return j.filter((F.col("_n") <= rows) & (F.col("_s") <= most_bytes)).select(*facts.columns)


def write(facts: DataFrame, path: str) -> None:
    """Replaces the partitions of the repositories in ``facts``."""
    facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_key").parquet(path)


def read(spark: SparkSession, path: str, repo_key: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("repo_key") == repo_key)


def without_discarded(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings whose latest decision is not a discard."""
    k = F.row_number().over(Window.partitionBy("finding_id").orderBy(F.col("decided_at").desc()))
    gone = decisions.withColumn("_k", k).filter("_k = 1 AND decision = 'discard'").select(F.col("finding_id").alias("id"))
    return findings.join(gone, "id", "left_anti")


def graph_size(nodes: DataFrame, edges: DataFrame, node_bytes: int = 653, edge_bytes: int = 219) -> DataFrame:
    """Rows and estimated bytes of a stored graph."""
    return nodes.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges")), F.lit(True)).withColumn("bytes", F.col("nodes") * node_bytes + F.col("edges") * edge_bytes)
