"""Ranking, grouping, paging and roll-ups of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seeded
from ..functions.stats import percent_rank_of_ties

#: Weights of a score and of reach, tiers, group thresholds.
SCORE = {"severity": 0.4, "impact": 0.35, "reach": 0.25}
REACH = {"pagerank": 0.5, "fan_in": 0.3, "in_cycle": 0.2}
TIER = {"correccion": 1.0, "arquitectura": 0.75, "mantenibilidad": 0.5, "higiene": 0.25}
GROUP_MIN, DEGENERATE_MIN, DEGENERATE_MEDIAN = 5, 20, 0.7
DEGENERATE_CONFIDENCE, INFERRED_CONFIDENCE, INFERRED_SHARE = 0.5, 0.7, 0.5
STORED, PAGE = 5000, 200
#: Coverage statuses from worst to best.
STATUS = ("error", "presupuesto-agotado", "no-aplicable", "sin-grafo", "sin-aristas", "sin-metricas", "corrio")


def reach_index(files: DataFrame) -> DataFrame:
    """Adds reach from pagerank, fan_in and in_cycle of a file; 0.5 where the file has no metrics."""
    known = files.filter(F.col("pagerank").isNotNull())
    ranked = percent_rank_of_ties(percent_rank_of_ties(known, "pagerank", "_rp"), "fan_in", "_rf")
    value = REACH["pagerank"] * F.col("_rp") + REACH["fan_in"] * F.col("_rf") + REACH["in_cycle"] * F.coalesce(F.col("in_cycle").cast("double"), F.lit(0.0))
    some = ranked.withColumn("reach", value).drop("_rp", "_rf")
    return some.unionByName(files.filter(F.col("pagerank").isNull()).withColumn("reach", F.lit(0.5)))


def score(findings: DataFrame) -> DataFrame:
    """Adds score from severity (ranked within its detector), impact, reach and confidence."""
    ranked = percent_rank_of_ties(findings, "severity", "_rs", ("detector_id",))
    value = (SCORE["severity"] * F.col("_rs") + SCORE["impact"] * F.col("impact") + SCORE["reach"] * F.coalesce("reach", F.lit(0.5))) * F.coalesce("confidence", F.lit(1.0))
    return ranked.withColumn("score", value).drop("_rs")


def impact(tier: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in TIER.items():
        out = F.when(tier == name, F.lit(value)).otherwise(out)
    return out


def group_key(findings: DataFrame) -> DataFrame:
    """Adds group_id: the declared key, else (file, kind) where it has five findings or more, else the finding itself."""
    n = findings.groupBy("file", "kind").agg(F.count(F.when(F.col("declared_key").isNull(), 1)).alias("_n"))
    j = findings.join(n, ["file", "kind"])
    key = F.when(F.col("declared_key").isNotNull(), F.concat(F.lit("key:"), "declared_key")).when(F.col("_n") >= GROUP_MIN, F.concat_ws("|", F.lit("file"), "file", "kind")).otherwise(F.concat(F.lit("one:"), "id"))
    return j.withColumn("group_id", key).drop("_n").select(*findings.columns, "group_id")


def groups(findings: DataFrame) -> DataFrame:
    """group_id, detector_id, n, median and best quality, degenerate, confidence, representative score and id, of scored findings with group_id."""
    g = findings.groupBy("group_id").agg(
        F.min("detector_id").alias("detector_id"),
        F.count("*").alias("n"),
        F.percentile("quality", 0.5).alias("median_quality"),
        F.percentile("score", 0.5).alias("median_score"),
        F.max("score").alias("best_score"),
        F.max(F.col("declared_key").isNotNull()).alias("declared"),
        F.avg(F.when(F.col("inferred"), 1.0).otherwise(0.0)).alias("inferred_share"),
        F.min_by("id", F.struct(-F.col("score"), F.col("id"))).alias("representative"),
    )
    degenerate = ~F.col("declared") & (F.col("n") >= DEGENERATE_MIN) & (F.col("median_quality") < DEGENERATE_MEDIAN)
    g = g.withColumn("degenerate", degenerate)
    confidence = F.least(F.when(F.col("degenerate"), F.lit(DEGENERATE_CONFIDENCE)).otherwise(F.lit(1.0)), F.when(F.col("inferred_share") > INFERRED_SHARE, F.lit(INFERRED_CONFIDENCE)).otherwise(F.lit(1.0)))
    return g.withColumns({"confidence": confidence, "group_score": F.when(F.col("degenerate"), F.col("median_score")).otherwise(F.col("best_score"))})


def round_robin(grouped: DataFrame) -> DataFrame:
    """Adds round (position of a group within its detector) and position (by round, score, id). A row is a group, not a finding."""
    r = F.row_number().over(Window.partitionBy("detector_id").orderBy(F.col("group_score").desc(), "group_id"))
    first = grouped.withColumn("round", r)
    return first.withColumn("position", F.row_number().over(Window.orderBy("round", F.col("group_score").desc(), "group_id")))


def capped(findings: DataFrame, cap: Column | int, by: str = "detector_id") -> DataFrame:
    """The most severe findings of each detector."""
    k = F.row_number().over(Window.partitionBy(by).orderBy(F.col("severity").desc(), "id"))
    return findings.withColumn("_k", k).filter(F.col("_k") <= cap).drop("_k")


def quota_page(findings: DataFrame, size: int, quota: int) -> DataFrame:
    """A page that takes at most ``quota`` of a kind by score, then fills up by score."""
    k = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("score").desc(), "id"))
    return findings.withColumn("_over", F.when(k <= quota, 0).otherwise(1)).orderBy("_over", F.col("score").desc(), "id").limit(size).drop("_over")


def page(findings: DataFrame, offset: int = 0, limit: int = PAGE) -> DataFrame:
    return findings.orderBy(F.col("score").desc(), "id").offset(offset).limit(limit)


def merge_rows(findings: DataFrame) -> DataFrame:
    """One row for each group_id with the places and hypotheses of all its members."""
    return findings.groupBy("group_id").agg(
        F.count("*").alias("member_count"),
        F.max("severity").alias("severity"),
        F.array_sort(F.collect_set(F.struct("file", "start_line", "end_line"))).alias("locations"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("hypotheses", F.array().cast("array<string>")))))).alias("hypotheses"),
    )


def rule_of_three(suggestions: DataFrame) -> DataFrame:
    """Keeps (kind, pattern) suggestions that occur three times or more; counted first, so that a frequent pair is not gathered."""
    often = suggestions.groupBy("kind", "pattern").agg(F.count("*").alias("_n")).filter("_n >= 3").drop("_n")
    return suggestions.join(often, ["kind", "pattern"], "left_semi")


def coverage_rollup(coverage: DataFrame) -> DataFrame:
    """(detector, language): the worst status, units and findings summed, missing united."""
    order = F.array_position(F.array(*map(F.lit, STATUS)), F.col("status"))
    return coverage.groupBy("detector_id", "language").agg(F.min_by("status", order).alias("status"), F.sum("units").cast("long").alias("units"), F.sum("findings").cast("long").alias("findings"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("missing")))).alias("missing"))


def sample_for_judgement(findings: DataFrame, n: int, seed: int, slug: str = "") -> DataFrame:
    """At most n findings of each kind, the first in the order that the seed, the repository and the kind give (``turn``)."""
    return findings.join(seeded.sample(findings, n, seed, slug), ["kind", "id"])
