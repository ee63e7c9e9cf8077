"""Identities of findings and their repair when they collide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finding_id(detector: Column, variant: Column, anchors: Column) -> Column:
    """detector ':' and the first 16 characters of the url-safe base64 SHA-1 of detector, variant and sorted anchors."""
    payload = F.concat(detector, F.lit(" "), F.coalesce(variant, F.lit("")), F.lit(" "), F.array_join(F.array_sort(anchors), ""))
    return F.concat(detector, F.lit(":"), F.substring(F.translate(F.base64(F.unhex(F.sha1(payload.cast("binary")))), "+/", "-_"), 1, 16))


def anchor(file: Column, symbol_path: Column, ordinal: Column | None = None) -> Column:
    """A place without line numbers."""
    base = F.concat(file, F.lit("#"), F.array_join(symbol_path, "."))
    return base if ordinal is None else F.concat(base, F.when(ordinal.isNotNull(), F.concat(F.lit("@"), ordinal.cast("string"))).otherwise(F.lit("")))


def disambiguate(findings: DataFrame) -> DataFrame:
    """Equal ids get `` dup k`` by reading order from the second on; ids spread the work, a group is one id's findings."""
    k = F.row_number().over(Window.partitionBy("id").orderBy("file", "start_line", "end_line", "title"))
    return findings.withColumn("_k", k).withColumn("id", F.when(F.col("_k") == 1, F.col("id")).otherwise(F.concat("id", F.lit(" dup "), F.col("_k").cast("string")))).drop("_k")


def occurrence(symbols: DataFrame) -> DataFrame:
    """Symbol ids ``sym:file#A.b``; further symbols of one path in a file get ``@n``."""
    path = F.array_join(F.concat("container", F.array("name")), ".")
    n = F.row_number().over(Window.partitionBy("file", "_path").orderBy("start_line", "family"))
    return symbols.withColumn("_path", path).withColumn("_n", n).withColumn("id", F.concat(F.lit("sym:"), "file", F.lit("#"), "_path", F.when(F.col("_n") > 1, F.concat(F.lit("@"), F.col("_n").cast("string"))).otherwise(F.lit("")))).drop("_path", "_n")
