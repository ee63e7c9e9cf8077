"""Fact tables read out of the star schema, so that every operator can run on the tables at hand.

Parts are symbols of files ``brand/type/pN.src``; consecutive lines of an order are edges between their parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import table


def nodes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    file = F.concat(F.col("p_brand"), F.lit("/"), F.translate("p_type", " ", "_"), F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".src"))
    return p.select(
        F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("symbol").alias("kind"), file.alias("file"), F.col("p_brand").alias("folder"), F.col("p_type").alias("module"),
        F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, "class").otherwise("function").alias("family"), (F.col("p_size") % 2 == 0).alias("exported"), F.lit(False).alias("member_of_class_like"),
        F.lit(1).alias("start_line"), F.col("p_size").alias("end_line"),
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_discount", "l_quantity")
    b = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("to"), F.col("l_quantity").cast("long").alias("weight"))
    kind = F.when(F.col("l_returnflag") == "A", "references").when(F.col("l_returnflag") == "N", "calls").otherwise("imports")
    prov = F.when(F.col("l_discount") < 0.02, "declared").when(F.col("l_discount") < 0.05, "resolved").when(F.col("l_discount") < 0.08, "inferred").otherwise("ambiguous")
    part = lambda c: F.concat(F.lit("part:"), F.col(c).cast("string"))
    return li.join(b, ["l_orderkey", "l_linenumber"]).select(part("l_partkey").alias("src"), part("to").alias("dst"), kind.alias("kind"), prov.alias("provenance"), "weight", F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("roles"))


SQL = """
nodes AS (
  SELECT 'part:' || p_partkey AS id, p_brand || '/' || replace(p_type, ' ', '_') || '/p' || p_partkey || '.src' AS file, p_brand || '/' || replace(p_type, ' ', '_') AS dir,
    p_brand AS folder, p_type AS module, p_name AS name, CASE WHEN p_size % 3 = 0 THEN 'class' ELSE 'function' END AS family, p_size % 2 = 0 AS exported, p_size FROM part
), raw AS (
  SELECT 'part:' || a.l_partkey AS src, 'part:' || b.l_partkey AS dst, CASE a.l_returnflag WHEN 'A' THEN 'references' WHEN 'N' THEN 'calls' ELSE 'imports' END AS kind,
    CASE WHEN a.l_discount < 0.02 THEN 'declared' WHEN a.l_discount < 0.05 THEN 'resolved' WHEN a.l_discount < 0.08 THEN 'inferred' ELSE 'ambiguous' END AS provenance,
    CAST(b.l_quantity AS BIGINT) AS weight, CASE WHEN a.l_linestatus = 'O' THEN 1 ELSE 2 END AS roles
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
), ranked AS (
  SELECT *, CASE provenance WHEN 'declared' THEN 3 WHEN 'resolved' THEN 2 WHEN 'inferred' THEN 1 ELSE 0 END AS s FROM raw
), best AS (SELECT *, max(s) OVER (PARTITION BY src, dst, kind) AS top FROM ranked),
merged AS (SELECT src, dst, kind, provenance, sum(weight)::BIGINT AS weight, bit_or(roles)::INTEGER AS roles FROM best WHERE s = top GROUP BY ALL),
fe AS (
  SELECT a.file AS src, b.file AS dst, sum(weight)::BIGINT AS weight FROM merged e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst
  WHERE provenance <> 'ambiguous' AND a.file <> b.file GROUP BY ALL
), me AS (
  SELECT a.folder AS src, b.folder AS dst, sum(weight)::BIGINT AS weight FROM merged e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst
  WHERE provenance <> 'ambiguous' AND a.folder <> b.folder AND kind = 'imports' GROUP BY ALL
), deg AS (SELECT id, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT src AS id, 0 AS i, 1 AS o FROM fe UNION ALL SELECT dst, 1, 0 FROM fe) GROUP BY id),
thin AS (SELECT DISTINCT a.file AS src, b.file AS dst FROM merged e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE provenance <> 'ambiguous' AND weight >= 49 AND a.file <> b.file),
und AS (SELECT src AS a, dst AS b FROM thin UNION SELECT dst, src FROM thin)
"""


def facts(spark: SparkSession, d: str, merged: bool = True) -> dict[str, DataFrame]:
    """Without ``merged``, edges as they come: the distinct ends of trusted edges are the same, as the strongest of equal edges is one of them; weights are not."""
    from ..operators.graph import merge_edges

    e = edges(spark, d)
    return {"nodes": nodes(spark, d), "edges": merge_edges(e) if merged else e, "files": nodes(spark, d).select(F.col("file").alias("path"))}


def thin(f: dict[str, DataFrame]) -> DataFrame:
    """A sparse file graph: the heavy edges."""
    from ..operators.graph import project

    return project(f["nodes"], f["edges"].filter("weight >= 49"), "file")


def all_files(f: dict[str, DataFrame]) -> DataFrame:
    """The whole file graph; its pairs (not its weights) also over edges that are not merged."""
    from ..operators.graph import project

    return project(f["nodes"], f["edges"], "file")


def functions(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as functions: numbers become their metrics."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("file"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("name"), F.lit("src").alias("language"),
        F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("fn_id"), F.lit(1).alias("start_line"), F.col("l_quantity").cast("int").alias("end_line"),
        (F.col("l_partkey") % 20).cast("int").alias("cognitive"), (F.col("l_suppkey") % 8).cast("int").alias("parameters"), (F.col("l_partkey") % 7).cast("int").alias("chain"),
        (F.col("l_returnflag") == "R").alias("is_constructor"), (F.col("l_linestatus") == "F").alias("chain_instantiates"), (F.col("l_returnflag") == "A").alias("is_factory_like"),
    )


FUNCTIONS_SQL = """
fn AS (SELECT 'o' || l_orderkey AS file, 'f' || l_linenumber AS symbol, CAST(l_quantity AS INTEGER) AS lines, (l_partkey % 20)::INTEGER AS cognitive, (l_suppkey % 8)::INTEGER AS parameters,
  (l_partkey % 7)::INTEGER AS chain, l_returnflag AS rf, l_linestatus AS ls FROM lineitem)
"""


def findings(spark: SparkSession, d: str) -> DataFrame:
    """Events as findings."""
    e = table(spark, d, "events")
    return e.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("detector_id"), F.col("event_type").alias("kind"), F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("file"),
        F.round("value", 2).alias("severity"), F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("k"), (F.col("event_id") % 21).cast("string"))).alias("declared_key"), (F.col("event_id") % 3 == 0).alias("inferred"),
        ((F.col("event_id") % 4 + 1) / 4).alias("impact"), ((F.col("user_id") % 10) / 10).alias("reach"), ((F.col("event_id") % 10) / 10).alias("quality"), F.lit(1.0).alias("confidence"),
        (F.col("event_id") % 100).cast("int").alias("start_line"), (F.col("event_id") % 100 + 5).cast("int").alias("end_line"),
    )


FINDINGS_SQL = """
f AS (SELECT 'e' || event_id AS id, event_type AS detector_id, event_type AS kind, 'u' || (user_id % 50) AS file, round(value, 2) AS severity,
  CASE WHEN event_id % 7 = 0 THEN 'k' || (event_id % 21) END AS declared_key, event_id % 3 = 0 AS inferred, (event_id % 4 + 1) / 4.0::DOUBLE AS impact, (user_id % 10) / 10.0::DOUBLE AS reach,
  (event_id % 10) / 10.0::DOUBLE AS quality, 1.0::DOUBLE AS confidence FROM events),
fs AS (SELECT *, (0.4 * CASE WHEN n > 1 THEN (lo - 1 + (c - 1) / 2.0::DOUBLE) / (n - 1) ELSE 0.5 END + 0.35 * impact + 0.25 * reach) * confidence AS score FROM (
  SELECT *, rank() OVER (PARTITION BY detector_id ORDER BY severity) AS lo, count(*) OVER (PARTITION BY detector_id, severity) AS c, count(*) OVER (PARTITION BY detector_id) AS n FROM f))
"""
