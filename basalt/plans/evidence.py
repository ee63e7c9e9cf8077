"""Evidence of findings from facts, one row to a finding, for the conditions of design hypotheses.

Each group of columns is one grouped plan over a fact table, joined by the function, type or file of the finding. A column is there only where
its facts are, so that what cannot be known stays missing and is reported as such (``hypotheses.attach``), and is null for findings
that it does not apply to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import cut
from ..operators.components import components

#: Measures of detectors that conditions name as they are.
MEASURES = ("arms", "capabilities", "chain", "cognitive", "copies", "fan_out", "layers", "operations", "parameters", "places", "repeats", "siblings", "sites", "targets")


def cohesion(uses: DataFrame) -> DataFrame:
    """file, type, tcc, cluster_members, cluster_fields, shared_fields over (file, type, member, field) uses.

    tcc is the share of member pairs that use a common field; pairs are counted by members' common fields, never listed beyond
    those that have one. Members fall into clusters by common fields; the cluster is the second largest, which could be a type of its own
    (of equals the one with the least member). Types of a single cluster have none (0 members).
    """
    u = cut(uses.select("file", "type", "member", "field").distinct())
    of = ["file", "type"]
    n = u.select(*of, "member").distinct().groupBy(*of).agg(F.count("*").alias("n"))
    pairs = u.join(u.withColumnRenamed("member", "other"), [*of, "field"]).filter("member < other").select(*of, "member", "other").distinct()
    linked = pairs.groupBy(*of).agg(F.count("*").alias("linked"))
    key = lambda c: F.concat_ws("\u0001", *of, c)
    # Members are tied by a star around the least one of each field, not by pairs.
    star = u.withColumn("first", F.min("member").over(Window.partitionBy(*of, "field"))).select(key("member").alias("a"), key("first").alias("b"))
    cluster = components(star)
    placed = u.withColumn("id", key("member")).join(cluster, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sized = placed.groupBy(*of, "component").agg(F.count_distinct("member").alias("members"), F.count_distinct("field").alias("fields"))
    order = F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("members"), "component"))  # clusters of one type
    second = sized.withColumn("turn", order).filter("turn = 2").select(*of, F.col("members").alias("cluster_members"), F.col("fields").alias("cluster_fields"))
    out = n.join(linked, of, "left").join(second, of, "left")
    possible = F.col("n") * (F.col("n") - 1) / 2
    return out.select(*of, F.when(possible > 0, F.coalesce("linked", F.lit(0)) / possible).otherwise(F.lit(1.0)).alias("tcc"), F.coalesce("cluster_members", F.lit(0)).alias("cluster_members"), F.coalesce("cluster_fields", F.lit(0)).alias("cluster_fields"), F.lit(0).alias("shared_fields"))


def _of_functions(facts: dict[str, DataFrame]) -> DataFrame:
    """file, symbol, start_line and what is known of the function."""
    f = facts["functions"].select("fn_id", "file", F.col("name").alias("symbol"), "start_line", "end_line", "is_constructor", "branches", "max_nesting", F.col("branches").alias("nested_blocks"), F.col("max_nesting").alias("spine_depth"))
    if "comment_lines" in facts:
        c = facts["comment_lines"].select("file", "line")
        n = f.select("fn_id", "file", "start_line", "end_line").join(c, "file").filter("line BETWEEN start_line AND end_line").groupBy("fn_id").agg(F.count("*").alias("comment_lines"))
        f = f.join(n, "fn_id", "left").withColumns({"comment_lines": F.coalesce("comment_lines", F.lit(0)), "comment_blocks": F.coalesce("comment_lines", F.lit(0))})
    if "returns" in facts:
        f = f.join(facts["returns"].groupBy("fn_id").agg(F.count("*").alias("guards")), "fn_id", "left")
    if "params" in facts:
        f = f.join(facts["params"].groupBy("fn_id").agg(F.sum(F.col("is_boolean").cast("int")).alias("flags")), "fn_id", "left")
    if "type_tests" in facts:
        t = facts["type_tests"].groupBy("fn_id").agg(F.count_distinct("subject").alias("subjects"), F.count("*").alias("values"), F.min("subject").alias("_subject"))
        f = f.join(t, "fn_id", "left")
        if "members" in facts:
            own = facts["members"].filter("kind = 'field'").select("file", F.col("name").alias("_subject")).distinct().withColumn("discriminant_is_own_field", F.lit(True))
            f = f.join(own, ["file", "_subject"], "left").withColumn("discriminant_is_own_field", F.when(F.col("_subject").isNotNull(), F.coalesce("discriminant_is_own_field", F.lit(False))))
        f = f.drop("_subject")
    return f.drop("fn_id", "end_line").dropDuplicates(["file", "symbol", "start_line"])


def _of_types(facts: dict[str, DataFrame]) -> DataFrame | None:
    """file, symbol and what is known of the type."""
    if "field_events" not in facts:
        return None
    e = facts["field_events"]
    t = cohesion(e.select("file", "type", "member", "field"))
    w = e.groupBy("file", "type").agg(F.max((F.col("event") == "fill").cast("int")).cast("boolean").alias("changes_state"), F.max(F.col("in_constructor") & (F.col("event") != "read")).alias("set_in_constructor"), F.count_distinct("member").alias("using_members"))
    t = t.join(w, ["file", "type"])
    if "members" in facts:
        m = facts["members"].groupBy("file", "type").agg(F.count("*").alias("members"), F.max(F.coalesce(F.col("declared_type").rlike("(?i)(list|collection|set|array)"), F.lit(False))).alias("keeps_list"))
        t = t.join(m, ["file", "type"], "left")
    return t.withColumnRenamed("type", "symbol")


def evidence(facts: dict[str, DataFrame], found: DataFrame) -> DataFrame:
    """finding_id, kind, and the columns that the facts at hand can tell. found: findings with ids."""
    e = found.select(F.col("id").alias("finding_id"), F.col("detector_id").alias("kind"), "file", "symbol", "start_line", "end_line", "variant", "measures")
    e = e.withColumns({m: F.element_at("measures", m) for m in MEASURES} | {"lines": F.coalesce(F.element_at("measures", "lines"), (F.col("end_line") - F.col("start_line") + 1).cast("double")), "files": F.element_at("measures", "files")})
    e = e.withColumns({"handler_statements": F.when(F.col("kind") == "empty-catch", F.lit(0)), "outside_uses": F.when(F.col("kind").isin("unreachable-code", "unused-symbol", "unused-variable"), F.lit(0)), "families": F.element_at("measures", "combinations"), "clump": F.when(F.col("kind") == "data-clump", F.size(F.split("variant", ",")))})
    if "functions" in facts:
        e = e.join(_of_functions(facts), ["file", "symbol", "start_line"], "left")
    types = _of_types(facts)
    e = e.drop("measures", "variant")
    return e if types is None else e.join(types, ["file", "symbol"], "left")
