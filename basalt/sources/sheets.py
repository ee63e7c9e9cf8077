"""Verdict sheets (CSV), benchmark percentiles (JSON) and censuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHEET = "id string, slug string, kind string, language string, pattern string, file string, start_line int, end_line int, symbol string, title string, detail string, verdict string, note string"
BENCHMARK = "metric string, language string, n long, p50 double, p90 double, p95 double, p99 double"


def read_sheet(spark: SparkSession, path: str, schema: str = SHEET) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', quote='"')


def write_sheet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("quoteAll", True).option("escape", '"').csv(path, header=True)


def read_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """metric -> language -> percentiles, flattened."""
    raw = spark.read.schema("benchmarks map<string, map<string, struct<n: long, p50: double, p90: double, p95: double, p99: double>>>").json(path, multiLine=True)
    return raw.select(F.explode("benchmarks").alias("metric", "by")).select("metric", F.explode("by").alias("language", "b")).select("metric", "language", "b.*")


def merge_verdicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """A new sample that keeps what people wrote, and the judged rows that it lost (still_present false)."""
    o = old.select("id", F.col("verdict").alias("_v"), F.col("note").alias("_n"))
    kept = new.join(o, "id", "left").withColumns({"verdict": F.coalesce(F.nullif("_v", F.lit("")), "verdict"), "note": F.coalesce(F.nullif("_n", F.lit("")), "note"), "still_present": F.lit(True)}).drop("_v", "_n")
    lost = old.filter("coalesce(verdict, '') <> ''").join(new.select("id"), "id", "left_anti").withColumn("still_present", F.lit(False))
    return kept.unionByName(lost, allowMissingColumns=True)


def census_json(census: DataFrame) -> DataFrame:
    """One JSON object with sorted keys; a census is one row to (file, kind) of one repository."""
    return census.groupBy(F.lit(0).alias("_")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n"))))).alias("json")).select("json")
