"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

from ..functions.session import checkpoint_dir, cut, dropping_shuffles, table

__all__ = ["SLICE_BYTES", "checkpoint_dir", "cut", "dropping_shuffles", "lean", "remove", "shuffle_partitions", "table", "trim"]

#: Bytes of text handled at once by the numpy code; whole documents only, so one longer document is one slice.
SLICE_BYTES = 1 << 20


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by Spark's own file system, wherever it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def trim() -> None:
    """Gives freed memory back to the system: worker processes outlive their tasks, and their allocators keep what was once used."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def lean(run: Callable) -> Callable:
    """A partition function that trims its worker at the end of the task."""

    def trimmed(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return trimmed
