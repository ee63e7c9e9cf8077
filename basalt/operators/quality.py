"""Precision, recall and coverage gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import wilson

#: Fixed value: the least share of true verdicts.
FLOOR = 0.5


def precision(verdicts: DataFrame, *by: str) -> DataFrame:
    """by, judged, true_n, precision with its 95 % interval, and whether it passes; doubtful and empty verdicts are not judged."""
    j = verdicts.filter(F.col("verdict").isin("verdadero", "falso"))
    g = j.groupBy(*by).agg(F.count("*").alias("judged"), F.sum((F.col("verdict") == "verdadero").cast("long")).alias("true_n"))
    lo, hi = wilson(F.col("true_n"), F.col("judged"))
    return g.withColumns({"precision": F.col("true_n") / F.col("judged"), "lower": lo, "upper": hi, "passes": F.col("true_n") / F.col("judged") >= FLOOR})


def recall(judged_true: DataFrame, pool: DataFrame) -> DataFrame:
    """Rows with status id, contenido or perdido: found by id, else by content key, else lost."""
    ids = pool.select("id").distinct().withColumn("_i", F.lit(True))
    keys = pool.select("content_key").distinct().withColumn("_c", F.lit(True))
    return judged_true.join(ids, "id", "left").join(keys, "content_key", "left").withColumn("status", F.when(F.col("_i"), F.lit("id")).when(F.col("_c"), F.lit("contenido")).otherwise(F.lit("perdido"))).drop("_i", "_c")


def language_coverage(coverage: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """Detectors by languages: the status of each."""
    return coverage.groupBy("detector_id").pivot("language", list(languages)).agg(F.first("status"))


def edge_census(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind", "provenance").agg(F.count("*").alias("edges"), F.sum("weight").cast("long").alias("weight"))


def benchmark(samples: DataFrame) -> DataFrame:
    """metric, language, n and nearest-rank p50 .. p99 of pooled samples (metric, language, value), from the histogram of values."""
    from pyspark.sql import Window

    h = samples.groupBy("metric", "language", "value").agg(F.count("*").alias("c"))
    w = Window.partitionBy("metric", "language")
    h = h.withColumns({"upto": F.sum("c").over(w.orderBy("value")), "n": F.sum("c").over(w)})
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * p), F.col("value"))).alias(f"p{round(p * 100)}")
    return h.groupBy("metric", "language").agg(F.max("n").alias("n"), *(at(p) for p in (0.5, 0.9, 0.95, 0.99)))


def leave_one_out(samples: DataFrame) -> DataFrame:
    """repo, metric, own p95 against the p95 of all other repositories."""
    repos = samples.select("repo").distinct()
    rest = samples.withColumnRenamed("repo", "_r").join(repos, F.col("_r") != F.col("repo")).select(F.concat_ws("|", "metric", F.lit("")).alias("metric"), F.col("repo").alias("language"), "value")
    own = benchmark(samples.select("metric", F.col("repo").alias("language"), "value")).select("metric", F.col("language").alias("repo"), F.col("p95").alias("own_p95"))
    others = benchmark(rest).select(F.regexp_replace("metric", r"\|$", "").alias("metric"), F.col("language").alias("repo"), F.col("p95").alias("rest_p95"))
    return own.join(others, ["metric", "repo"]).withColumn("ratio", F.col("own_p95") / F.col("rest_p95"))
