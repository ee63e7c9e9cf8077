"""Session helpers: reliable checkpoints in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
_AUTO_BUCKETS = "spark.sql.sources.bucketing.autoBucketedScan.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a session without one (tests) gets a folder of its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="basalt-checkpoint-"))
    return sc.getCheckpointDir()


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def dropping_shuffles(spark: SparkSession):
    """Queries run within drop their shuffle files when they end; only for those whose result is stored."""
    return _set(spark, _CLEAN_UP, "true")


def cut(df: DataFrame) -> DataFrame:
    """Materialises df reliably, cuts its lineage, and drops the shuffle files that led to it."""
    checkpoint_dir(df.sparkSession)
    with dropping_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, in compressed columns: for tables of many rows of short strings, which a checkpoint would write out row by row."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    with dropping_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*dfs: DataFrame) -> None:
    """Removes the files of ``stored`` tables that nothing reads any more."""
    for df in dfs:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def stored_by(df: DataFrame, parts: int, by: str) -> DataFrame:
    """As ``stored``, in as many buckets by a column: what joins and groups by it later reads bucket by bucket, without a shuffle, and is never broadcast (Spark would judge by the compressed files)."""
    spark, name = df.sparkSession, f"stored_{uuid.uuid4().hex}"
    with dropping_shuffles(spark), _set(spark, _ALL_KEYS, "false"), _set(spark, _AUTO_BUCKETS, "false"):  # joins by more columns and unions stay within the buckets too
        df.write.bucketBy(parts, by).option("path", f"{checkpoint_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    out = spark.table(name).hint("merge")
    spark.sql(f"DROP TABLE {name}")  # the name only: its files are outside the warehouse
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written there to its end."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df by the hash of columns over all shuffle partitions: adaptive execution would unite them up to 64 MB as shuffled, which short strings make many times that in memory."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
