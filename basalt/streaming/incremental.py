"""Incremental facts as a stream of files, and windows over event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.session import cut
from ..operators import extract
from ..sources import cache, scan

FILES = "path string, content string, repo_key string, seen_at timestamp"


def file_stream(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """New Parquet files of (path, content, repo_key, seen_at) rows."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", per_batch).parquet(path)


def keep_facts(stream: DataFrame, facts_path: str, checkpoint: str, version: str, done: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Extracts facts of files whose content the cache has not seen, and replaces the partitions of their repositories."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        files = df.select("repo_key", F.col("path").alias("file_path"), "content", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), F.col("seen_at").alias("last_used_at"))
        try:
            old = spark.read.parquet(facts_path)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            old = None
        new = files if old is None else cache.misses(old, files, version)
        rows = extract.extract(new.select(F.concat_ws("|", "repo_key", "file_path").alias("path"), scan.language(F.col("file_path")).alias("language"), "content"))
        per = rows.groupBy("path").agg(F.collect_list(F.struct("kind", "row")).alias("facts")).withColumnRenamed("path", "_key")  # of one file
        out = new.withColumn("_key", F.concat_ws("|", "repo_key", "file_path")).join(per, "_key", "left").select("repo_key", "file_path", "content_hash", F.lit(version).alias("analyzer_version"), "facts", F.length("content").cast("long").alias("bytes"), "last_used_at")
        if old is not None:
            touched = old.join(files.select("repo_key").distinct(), "repo_key", "left_semi")
            out = cache.upsert(touched.select(*out.columns), out)
        cache.write(cut(out), facts_path)
        if done:
            done(new)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dirty_names(changed: DataFrame, references: DataFrame) -> DataFrame:
    """Files that refer to a name that changed files declare: what has to be resolved again."""
    return references.join(changed.select("name").distinct(), "name", "left_semi").select("file").distinct()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and values by type in tumbling windows under a watermark; works on streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")
