"""Analysis of a source tree end to end, and of changed files only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import occurrence
from ..functions.session import cut
from ..operators import detect, extract, flow, graph, hypotheses, metrics, ranking, resolve
from ..operators import detect_inter, detect_intra  # noqa: F401  they register detectors
from ..sources import scan
from .evidence import evidence


def by_name(rows: DataFrame, types: DataFrame, kind: str) -> DataFrame:
    """Edges from _owner to the type of a name: of one file's own type or the only one of that name declared, of several ambiguous.

    rows: file, _owner, type, weight; types: _file, type, type_id. Names that no type has give no edge.
    """
    named = types.groupBy("type").agg(F.count("*").alias("_n"), F.min("type_id").alias("_any"))
    here = types.groupBy(F.col("_file").alias("file"), "type").agg(F.min("type_id").alias("_here"))
    j = rows.join(named, "type").join(here, ["file", "type"], "left")
    sure = F.col("_here").isNotNull() | (F.col("_n") == 1)
    return j.select(F.col("_owner").alias("src"), F.coalesce("_here", "_any").alias("dst"), F.lit(kind).alias("kind"), F.when(sure, F.lit("declared")).otherwise(F.lit("ambiguous")).alias("provenance"), "weight").filter("src <> dst")


def typed_edges(slots: DataFrame, owner: DataFrame, types: DataFrame) -> DataFrame:
    """``declares-type`` edges from owners of written types. slots: file, scope, type; owner: file, path, _owner."""
    s = slots.withColumn("path", F.array_join("scope", ".")).groupBy("file", "path", "type").agg(F.count("*").alias("weight"))
    return by_name(s.join(owner, ["file", "path"]), types, "declares-type")


def flowing_types(facts: dict[str, DataFrame], types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(origins, flows) of ``flow.propagate``: sites are ``file#scope:name`` for variables, results (``return``) and fields (of the class).

    Written types are declared, made values are resolved. A call flows from the result of the function of that name, in its own file or the only one there is.
    """
    fields = lambda c: F.col(c).startswith(".")
    site = lambda scope, name: F.concat(F.col("file"), F.lit("#"), F.array_join(scope, "."), F.lit(":"), name)
    outer = F.when(F.size("scope") > 0, F.slice("scope", 1, F.size("scope") - 1)).otherwise(F.col("scope"))
    at = lambda c: F.when(fields(c), site(outer, F.col(c))).otherwise(site(F.col("scope"), F.col(c)))
    v = facts["value_flows"].withColumn("dst", at("target"))
    known = types.select(F.col("type").alias("source")).distinct()
    made = v.filter("form = 'call'").join(known, "source", "left_semi").select(F.col("dst").alias("site"), F.col("source").alias("type"), F.lit("resolved").alias("provenance"))
    last = F.element_at(F.split(F.regexp_replace("type", r"[<\[ ].*$", ""), r"\."), -1)
    owned = facts["members"].filter("kind = 'field' AND declared_type IS NOT NULL").select("file", F.col("type").alias("owner"), "name", F.col("declared_type").alias("type"))
    written = owned.join(types.select(F.col("_file").alias("file"), F.col("type").alias("owner"), "path"), ["file", "owner"]).select(F.concat("file", F.lit("#"), "path", F.lit(":."), "name").alias("site"), last.alias("type"))
    scoped = facts["params"].filter("type IS NOT NULL").select("file", F.concat(F.regexp_replace(F.regexp_replace("fn_id", r"@\d+$", ""), r"^(.*?)#(.*)$", "$1#$2"), F.lit(":"), "name").alias("site"), last.alias("type"))
    written = written.unionByName(scoped.select("site", "type")).join(known.withColumnRenamed("source", "type"), "type", "left_semi").select("site", "type", F.lit("declared").alias("provenance"))
    slots = v.filter("form = 'slot'").select(at("source").alias("src"), "dst")
    functions = facts["symbols"].filter("family IN ('function', 'method')").select("file", F.col("name").alias("source"), F.concat("file", F.lit("#"), F.array_join(F.concat("container", F.array("name")), "."), F.lit(":return")).alias("src")).distinct()
    here = functions.groupBy("file", "source").agg(F.min("src").alias("_here"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    only = functions.groupBy("source").agg(F.min("src").alias("_only"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    calls = v.filter("form = 'call'").join(known, "source", "left_anti").join(here, ["file", "source"], "left").join(only, "source", "left").select(F.coalesce("_here", "_only").alias("src"), "dst").filter("src IS NOT NULL")
    return made.unionByName(written), slots.unionByName(calls)


def propagated_edges(reached: DataFrame, origins: DataFrame, owner: DataFrame, types: DataFrame) -> DataFrame:
    """``declares-type`` edges for what reached sites without a written type, from the function or class that has the site; several types of a site are ambiguous."""
    fixed = origins.filter("provenance = 'declared'").select("site").distinct()
    r = reached.filter(F.col("type") != flow.ANY).join(fixed, "site", "left_anti").withColumn("_k", F.count("*").over(Window.partitionBy("site")))  # at most flow.MOST rows to a site
    parts = r.select(F.regexp_extract("site", r"^(.*?)#", 1).alias("file"), F.regexp_extract("site", r"#(.*):[^:]*$", 1).alias("path"), "type", "_k")
    g = parts.join(owner, ["file", "path"]).groupBy("file", "_owner", "type").agg(F.count("*").alias("weight"), F.max("_k").alias("_k"))
    e = by_name(g.filter("_k = 1").select("file", "_owner", "type", "weight"), types, "declares-type").withColumn("provenance", F.when(F.col("provenance") == "declared", F.lit("inferred")).otherwise(F.col("provenance")))
    return e.unionByName(by_name(g.filter("_k > 1").select("file", "_owner", "type", "weight"), types, "declares-type").withColumn("provenance", F.lit("ambiguous")))


def stores(facts: dict[str, DataFrame], owner: DataFrame, types: DataFrame) -> DataFrame:
    """``stores`` edges from a class to the types that it makes and keeps in a field of its own.

    A value may pass through variables of the function on its way: names are followed back to the call that made it, by doubling what
    each name stands for; a name that is assigned from several places stands for none.
    """
    v = facts["value_flows"].withColumn("path", F.array_join("scope", ".")).select("file", "path", "target", "form", "source").distinct()
    once = v.join(v.groupBy("file", "path", "target").agg(F.count("*").alias("_n")).filter("_n = 1").drop("_n"), ["file", "path", "target"])
    alias = cut(once.filter("NOT startswith(target, '.')"))
    ends = v.filter("startswith(target, '.')")
    while True:
        back = alias.select("file", "path", F.col("target").alias("source"), F.col("form").alias("_form"), F.col("source").alias("_source"))
        step = lambda df, back=back: df.join(back.filter("source <> _source"), ["file", "path", "source"], "left").withColumns({"new": F.coalesce("_source", "source"), "newer": F.coalesce("_form", "form")})
        slots = alias.filter("form = 'slot'")
        longer = cut(step(slots).select("file", "path", "target", F.col("newer").alias("form"), F.col("new").alias("source")).unionByName(alias.filter("form = 'call'").select("file", "path", "target", "form", "source")))
        # Names that follow each other in a circle never come to a call and are left out once nothing else moves.
        if longer.exceptAll(alias.select(*longer.columns)).filter("form = 'call'").isEmpty():
            break
        alias = longer
    made = ends.filter("form = 'slot'").join(alias.filter("form = 'call'").select("file", "path", F.col("target").alias("source"), F.col("source").alias("made")), ["file", "path", "source"]).select("file", "path", "made")
    made = made.unionByName(ends.filter("form = 'call'").select("file", "path", F.col("source").alias("made")))
    at = made.withColumn("path", F.regexp_replace("path", r"\.[^.]*$", "")).join(owner, ["file", "path"])
    return by_name(at.groupBy("file", "_owner", F.col("made").alias("type")).agg(F.count("*").alias("weight")), types, "stores").filter("src <> dst").withColumn("provenance", F.when(F.col("provenance") == "declared", F.lit("resolved")).otherwise(F.col("provenance")))


def indirect_calls(calls: DataFrame, members: DataFrame, symbols: DataFrame) -> DataFrame:
    """``invokes-indirect`` edges from a member to the carrier ``carrier:file#type.field`` of an own field on which it calls what its own type does not declare."""
    own = members.filter("kind = 'field'").select("file", "type", F.col("name").alias("receiver")).distinct()
    here = members.filter("kind <> 'field'").select("file", "type", "name").distinct()
    at = symbols.filter("family = 'method'").select("file", F.element_at("container", -1).alias("type"), F.col("name").alias("member"), F.col("id").alias("src"))
    c = calls.join(own, ["file", "type", "receiver"], "left_semi").join(here, ["file", "type", "name"], "left_anti").join(at, ["file", "type", "member"])
    return c.groupBy("src", F.concat(F.lit("carrier:"), "file", F.lit("#"), "type", F.lit("."), "receiver").alias("dst")).agg(F.count("*").alias("weight")).select("src", "dst", F.lit("invokes-indirect").alias("kind"), F.lit("inferred").alias("provenance"), "weight")


def build_graph(facts: dict[str, DataFrame], files: DataFrame) -> dict[str, DataFrame]:
    """Adds nodes and edges to extracted facts: containment, imports, resolved references, inheritance, constructor calls, written and propagated types, stored ones, functions as values, calls on own fields, matching signatures."""
    symbols = occurrence(facts["symbols"]).join(files.select(F.col("path").alias("file"), "language"), "file", "left_semi")
    targets = resolve.import_targets(facts["imports"], files)
    imports = targets.select(F.concat(F.lit("file:"), "file").alias("src"), F.concat(F.lit("file:"), "target").alias("dst"), F.lit("imports").alias("kind"), F.lit("declared").alias("provenance"), F.lit(1).cast("long").alias("weight"))
    refs = facts["references"].withColumns({"ref_id": F.concat_ws(":", "file", F.col("line").cast("string"), F.col("column").cast("string"), "name", F.coalesce("qualifier", F.lit("")), F.array_join("scope", ".")), "qualifier_is_bare_constant": F.coalesce(F.col("qualifier").rlike("^[A-Z]\\w*$"), F.lit(False)), "shadowed_locally": F.lit(False), "in_type_slot": F.lit(False)}).dropDuplicates(["ref_id", "is_callee"])
    refs = refs.withColumn("ref_id", F.concat_ws(":", "ref_id", F.col("is_callee").cast("string")))
    owner = symbols.select("file", F.array_join(F.concat("container", F.array("name")), ".").alias("path"), F.col("id").alias("_owner")).groupBy("file", "path").agg(F.min("_owner").alias("_owner"))
    refs = refs.withColumn("path", F.array_join("scope", ".")).join(owner, ["file", "path"], "left").withColumn("from_id", F.coalesce("_owner", F.concat(F.lit("file:"), "file"))).drop("_owner", "path")
    reach = resolve.closure(targets.select("file", "target")) if "imports" in facts else None
    resolved = cut(resolve.edges_of(refs, symbols, reach).select("src", "dst", "kind", "provenance", "weight"))
    types = symbols.filter("family = 'class'").select(F.col("file").alias("_file"), F.col("name").alias("type"), F.col("id").alias("type_id"), F.array_join(F.concat("container", F.array("name")), ".").alias("path"))
    bases = facts["supertypes"].withColumn("base", F.element_at(F.split("base", r"\."), -1)).join(types.select(F.col("_file").alias("file"), "type", F.col("type_id").alias("_owner")), ["file", "type"])
    form = lambda kind: by_name(bases.filter(F.coalesce("form", F.lit("extends")) == kind).select("file", "_owner", F.col("base").alias("type"), F.lit(1).cast("long").alias("weight")), types, kind)
    kin = form("extends").unionByName(form("implements"))
    made = resolved.filter("kind = 'calls'").join(types.select(F.col("type_id").alias("dst")).distinct(), "dst", "left_semi").withColumn("kind", F.lit("instantiates"))
    written = typed_edges(facts["typed_slots"], owner, types)
    if "value_flows" in facts:
        origins, flows = flowing_types(facts, types)
        origins = cut(origins)
        written = written.unionByName(propagated_edges(flow.propagate(origins, flows), origins, owner, types))
    members = facts["members"].join(types.select(F.col("_file").alias("file"), "type", "type_id").groupBy("file", "type").agg(F.min("type_id").alias("type_id")), ["file", "type"], "left")
    answers = resolve.satisfies(members.filter("kind = 'method' AND type_id IS NOT NULL AND name NOT LIKE '\\_\\_%'").select(F.col("type_id").alias("type"), "name", "arity")).withColumns({"kind": F.lit("satisfies"), "weight": F.lit(1).cast("long")})
    more, carriers = [], None
    if "value_flows" in facts:
        more.append(stores(facts, owner, types))
    if "member_calls" in facts:
        indirect = indirect_calls(facts["member_calls"].withColumnRenamed("callee", "name"), facts["members"], symbols)
        more.append(indirect)
        carriers = indirect.select(F.col("dst").alias("id"), F.lit("carrier").alias("kind"), F.regexp_extract("dst", r"^carrier:(.*)#", 1).alias("file"), F.regexp_extract("dst", r"([^.]*)$", 1).alias("name")).distinct()
    derived = [x.select("src", "dst", "kind", "provenance", "weight") for x in (made, resolve.carries(resolved, symbols), written, answers, *more)]
    edges = graph.containment(files).unionByName(graph.symbol_containment(symbols)).unionByName(imports).unionByName(resolved).unionByName(kin)
    for x in derived:
        edges = edges.unionByName(x)
    file_nodes = files.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("kind"), F.col("path").alias("file"), F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), F.col("path").alias("name"))
    nodes = file_nodes.unionByName(symbols.select("id", F.lit("symbol").alias("kind"), "file", F.regexp_replace("file", "/?[^/]*$", "").alias("folder"), "name", "family", "arity", "exported", "member_of_class_like", "start_line", "end_line"), allowMissingColumns=True)
    if carriers is not None:
        nodes = nodes.unionByName(carriers.withColumn("folder", F.regexp_replace("file", "/?[^/]*$", "")), allowMissingColumns=True)
    ids = types.groupBy(F.col("_file").alias("file"), "type").agg(F.min("type_id").alias("type_id"))
    told = {}
    if "products" in facts:
        told["products"] = facts["products"].join(ids, ["file", "type"])
        told["call_sequences"] = facts["call_sequences"].join(ids, ["file", "type"], "left")
    if "member_uses" in facts:  # a type that is declared once, or in the client's own file
        one = types.groupBy("type").agg(F.count("*").alias("_n"), F.min("type_id").alias("_any"))
        told["member_uses"] = facts["member_uses"].join(one, "type").join(ids, ["file", "type"], "left").filter("type_id IS NOT NULL OR _n = 1").select("file", F.coalesce("type_id", "_any").alias("type_id"), "member")
    return facts | told | {"members": members, "nodes": cut(nodes), "edges": cut(graph.merge_edges(edges)), "files": files.select("path", "language")}


def analyze(spark: SparkSession, files: DataFrame, two_pass: bool = True) -> dict[str, DataFrame]:
    """files: path, content. Tables: files, facts of each kind, nodes, edges, findings (scored, grouped), coverage, hypotheses (arbitrated), hypothesis_coverage."""
    classified = cut(scan.classify(files))
    kept = classified.filter("excluded IS NULL AND language IS NOT NULL")
    facts = extract.facts_of_files(kept)
    if two_pass:
        facts = build_graph(facts, kept)
    found, coverage = detect.run_detectors(spark, facts)
    found = cut(found)
    if two_pass:
        e = graph.project(facts["nodes"], facts["edges"], "file")
        rank = metrics.pagerank(e).withColumnRenamed("id", "file")
        cyclic = metrics.scc(e).select(F.col("id").alias("file"), F.lit(True).alias("in_cycle"))
        per_file = found.select("file").distinct().join(rank, "file", "left").join(cyclic, "file", "left")
        found = found.join(ranking.reach_index(per_file).select("file", "reach"), "file", "left")
    else:
        found = found.withColumn("reach", F.lit(0.5))
    scored = ranking.score(found.withColumn("confidence", F.lit(1.0)))
    grouped = ranking.group_key(scored.withColumn("declared_key", F.lit(None).cast("string")))
    known = cut(evidence(facts, found))
    proposed, lacking = hypotheses.attach(known)
    places = proposed.join(known.select("finding_id", "file", "start_line", "end_line"), "finding_id").select("finding_id", "pattern", "file", "start_line", "end_line")
    return facts | {"scanned": classified, "findings": hypotheses.advise(grouped), "coverage": coverage, "hypotheses": hypotheses.arbitrate(proposed, places), "hypothesis_coverage": lacking}
