"""Detectors within a function, a file or a type, over fact tables of the extractor (see ``basalt.operators.extract``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .detect import Facts, detector, findings

FN, FILE = "intra-function", "intra-file"


def _fn(df: DataFrame, id: str, severity, variant=None, **m) -> DataFrame:
    return findings(df, id, severity, symbol="name", start="start_line", end="end_line", variant=variant, **m)


def _of(facts: Facts, rows: DataFrame) -> DataFrame:
    """Rows with fn_id joined to their function's place."""
    return rows.join(facts["functions"].select("fn_id", "file", "name", "start_line", "end_line"), "fn_id")


@detector("complexity", FN, "mantenibilidad", ("functions",), cognitive=15)
def complexity(facts, t):
    return _fn(facts["functions"].filter(F.col("cognitive") >= t["cognitive"]), "complexity", 30 + (F.col("cognitive") - t["cognitive"]) * 3, cognitive="cognitive")


@detector("long-function", FN, "mantenibilidad", ("functions",), lines=45)
def long_function(facts, t):
    """Lines from the declared floor, or from the language's p95 where ``benchmarks`` (language, metric, p95) has a higher one."""
    f = facts["functions"].withColumn("lines", F.col("end_line") - F.col("start_line") + 1)
    floor = F.lit(float(t["lines"]))
    if "benchmarks" in facts:
        b = facts["benchmarks"].filter("metric = 'functionLines'").select("language", "p95")
        f, floor = f.join(F.broadcast(b), "language", "left"), F.greatest(floor, F.coalesce("p95", floor))  # one row to a language
    return _fn(f.filter(F.col("lines") >= floor), "long-function", 20 + F.col("lines") / 2, lines="lines")


@detector("long-parameter-list", FN, "higiene", ("functions",), parameters=6)
def long_parameter_list(facts, t):
    variant = F.when(F.col("is_constructor"), F.lit("constructor"))
    return _fn(facts["functions"].filter(F.col("parameters") >= t["parameters"]), "long-parameter-list", 25 + F.col("parameters") * 5, variant, parameters="parameters")


@detector("conditional-chain", FN, "mantenibilidad", ("functions",), chain=5)
def conditional_chain(facts, t):
    variant = F.when(F.col("chain_instantiates") & ~F.col("is_factory_like"), F.lit("instantiates")).otherwise(F.lit("ladder"))
    return _fn(facts["functions"].filter(F.col("chain") >= t["chain"]), "conditional-chain", 45 + F.col("chain") * 6, variant, chain="chain")


@detector("many-returns", FN, "higiene", ("returns", "functions"), most=3)
def many_returns(facts, t):
    n = facts["returns"].groupBy("fn_id").agg(F.count("*").alias("n")).filter(F.col("n") > t["most"])
    return _fn(_of(facts, n), "many-returns", 30 + F.col("n") * 10, returns="n")


@detector("boolean-complexity", FN, "mantenibilidad", ("bool_chains", "functions"), operators=2)
def boolean_complexity(facts, t):
    b = facts["bool_chains"].filter((F.col("operators") > t["operators"]) & (F.col("families") > 1))
    return findings(_of(facts, b), "boolean-complexity", 30 + F.col("operators") * 10, symbol="name", start="line", end="line", operators="operators")


@detector("boolean-flag-param", FN, "higiene", ("params", "conditions", "functions"))
def boolean_flag_param(facts, t):
    """A boolean parameter that is the whole condition of a branch."""
    p = facts["params"].filter("is_boolean").select("fn_id", F.col("name").alias("param"))
    hit = facts["conditions"].filter(F.col("is_bare_name")).select("fn_id", F.col("text").alias("param")).distinct()
    j = p.join(hit, ["fn_id", "param"], "left_semi")
    return _fn(_of(facts, j), "boolean-flag-param", 45.0, F.col("param"))


@detector("argument-mutation", FN, "correccion", ("params", "assignments", "functions"))
def argument_mutation(facts, t):
    """Assignments whose base name is an own parameter, by rebinding or member mutation."""
    a = facts["assignments"].join(facts["params"].select("fn_id", F.col("name").alias("base")), ["fn_id", "base"], "left_semi")
    g = a.groupBy("fn_id", "base", "is_member").agg(F.count("*").alias("n"))
    return _fn(_of(facts, g), "argument-mutation", F.when(F.col("is_member"), F.lit(50)).otherwise(F.lit(30)) + 5 * F.col("n"), F.when(F.col("is_member"), F.concat(F.lit("member:"), "base")).otherwise(F.concat(F.lit("rebind:"), "base")), assignments="n")


@detector("empty-catch", FN, "correccion", ("handlers",))
def empty_catch(facts, t):
    return findings(facts["handlers"].filter(F.col("statements") == 0), "empty-catch", 55.0, symbol="fn_name", start="line", end="line")


@detector("flag-accumulator", FN, "mantenibilidad", ("guarded_assignments", "functions"), layers=3)
def flag_accumulator(facts, t):
    """A target reassigned under several guards that share no name."""
    g = facts["guarded_assignments"].select("fn_id", "target", "guard_id", "condition_names").distinct()
    names = g.select("fn_id", "target", "guard_id", F.explode_outer("condition_names").alias("x")).groupBy("fn_id", "target", "x").agg(F.count_distinct("guard_id").alias("c"))
    shared = names.filter((F.col("c") > 1) & F.col("x").isNotNull()).select("fn_id", "target").distinct()
    n = g.groupBy("fn_id", "target").agg(F.count_distinct("guard_id").alias("n")).filter(F.col("n") >= t["layers"]).join(shared, ["fn_id", "target"], "left_anti")
    return _fn(_of(facts, n), "flag-accumulator", 40 + F.col("n") * 12, F.col("target"), layers="n")


@detector("type-switch", FN, "mantenibilidad", ("type_tests", "functions"), arms=1)
def type_switch(facts, t):
    n = facts["type_tests"].groupBy("fn_id", "decision_id", "subject").agg(F.count("*").alias("arms"), F.max("form").alias("form")).filter(F.col("arms") > t["arms"])
    return _fn(_of(facts, n), "type-switch", 45 + F.col("arms") * 8, F.col("form"), arms="arms")


@detector("unreachable-code", FN, "correccion", ("statements",), presence=1)
def unreachable_code(facts, t):
    """Executable siblings after a jump of the same block; the window is one block's statements."""
    w = Window.partitionBy("file", "block_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    s = facts["statements"].withColumn("after", F.coalesce(F.max(F.col("is_jump").cast("int")).over(w), F.lit(0))).filter((F.col("after") == 1) & F.col("is_executable"))
    g = s.groupBy("file", "fn_name", "block_id").agg(F.count("*").alias("n"), F.min("line").alias("line"), F.max("line").alias("last")).filter(F.col("n") >= t["presence"])
    return findings(g, "unreachable-code", 55 + (F.col("n") - 1) * 10, symbol="fn_name", start="line", end="last", statements="n")


@detector("demeter-chain", FN, None, ("access_chains", "functions"), registered=False, links=4)
def demeter_chain(facts, t):
    a = facts["access_chains"].filter(F.col("links") >= t["links"])
    return findings(_of(facts, a), "demeter-chain", F.least(F.lit(65), 30 + F.col("links") * 5), symbol="name", start="line", end="line", links="links")


@detector("unused-variable", FN, None, ("declarations", "uses", "functions"), registered=False)
def unused_variable(facts, t):
    d = facts["declarations"].filter(~F.col("imposed")).join(facts["uses"].select("fn_id", "variable").distinct(), ["fn_id", "variable"], "left_anti")
    return _fn(_of(facts, d), "unused-variable", F.when(F.col("is_parameter"), F.lit(25)).otherwise(F.lit(35)), F.col("variable"))


@detector("commented-out-code", FILE, "higiene", ("comment_lines",), cap=120, lines=2)
def commented_out_code(facts, t):
    """Runs of adjacent comment lines with several that read like code: gaps and islands by line minus row number."""
    c = facts["comment_lines"]
    code = F.col("text").rlike(r"[;{}]\s*$|^\s*(if|for|while|return|import|def|class|var|let|const)\b.*[=(:;{]|^\s*[\w.\[\]]+\s*=\s*\S|^\s*[\w.]+\(.*\)\s*;?\s*$") & ~F.col("text").rlike(r"^(\s*\w+[,.]?){6,}$")
    island = F.col("line") - F.row_number().over(Window.partitionBy("file").orderBy("line"))
    g = c.withColumns({"island": island, "is_code": code}).groupBy("file", "island").agg(F.sum(F.col("is_code").cast("int")).alias("n"), F.min("line").alias("a"), F.max("line").alias("b")).filter(F.col("n") >= t["lines"])
    return findings(g, "commented-out-code", 25 + F.col("n") * 4, start="a", end="b", code_lines="n")


@detector("data-clump", FILE, "mantenibilidad", ("params", "functions"), group=3, repeats=3)
def data_clump(facts, t):
    """The same parameter names in several signatures of different operations in a file."""
    sets = facts["params"].groupBy("fn_id").agg(F.array_sort(F.collect_set("name")).alias("names")).filter(F.size("names") >= t["group"])
    g = sets.join(facts["functions"].select("fn_id", "file", "name", "start_line"), "fn_id").groupBy("file", "names").agg(F.count("*").alias("n"), F.count_distinct("name").alias("ops"), F.min("start_line").alias("a")).filter((F.col("n") >= t["repeats"]) & (F.col("ops") >= t["repeats"]))
    return findings(g, "data-clump", 30 + F.col("n") * 10 + F.size("names") * 3, start="a", end="a", variant=F.array_join("names", ","), repeats="n")


@detector("primitive-obsession", FILE, "mantenibilidad", ("params", "functions"), same=3)
def primitive_obsession(facts, t):
    g = facts["params"].filter(F.col("is_primitive")).groupBy("fn_id", "type").agg(F.count("*").alias("n")).filter(F.col("n") >= t["same"])
    return _fn(_of(facts, g), "primitive-obsession", 40 + F.col("n") * 10, F.col("type"), same_type="n")


@detector("large-class", FILE, "mantenibilidad", ("members",), members=47)
def large_class(facts, t):
    g = facts["members"].groupBy("file", "type").agg(F.count("*").alias("n")).filter(F.col("n") >= t["members"])
    return findings(g, "large-class", 40 + F.col("n"), symbol="type", members="n")


@detector("data-class", FILE, None, ("members",), cap=60, registered=False, fields=3)
def data_class(facts, t):
    m = facts["members"].groupBy("file", "type").agg(F.sum(F.expr("int(kind = 'field' AND exposed)")).alias("fields"), F.sum(F.expr("int(kind = 'accessor')")).alias("accessors"), F.sum(F.expr("int(kind = 'method')")).alias("behaviour"))
    return findings(m.filter((F.col("fields") >= t["fields"]) & (F.col("accessors") >= 1) & (F.col("behaviour") == 0)), "data-class", 30 + F.col("fields") * 6, symbol="type", fields="fields")


@detector("repeated-switch", FILE, "mantenibilidad", ("switches",), most=1)
def repeated_switch(facts, t):
    g = facts["switches"].groupBy("file", "subject").agg(F.count("*").alias("n"), F.min("line").alias("a")).filter(F.col("n") > t["most"])
    return findings(g, "repeated-switch", 40 + F.col("n") * 10, start="a", end="a", variant=F.col("subject"), places="n")


@detector("inheritance-family", FILE, "mantenibilidad", ("supertypes",), most=1)
def inheritance_family(facts, t):
    g = facts["supertypes"].groupBy("file", "base").agg(F.count_distinct("type").alias("n")).filter(F.col("n") > t["most"])
    return findings(g, "inheritance-family", 15.0, symbol="base", subclasses="n")


@detector("self-referential-member", FILE, "mantenibilidad", ("members",))
def self_referential_member(facts, t):
    return findings(facts["members"].filter(F.col("declared_type") == F.col("type")), "self-referential-member", 15.0, symbol="type", variant=F.col("name"))


@detector("refused-bequest", FILE, "mantenibilidad", ("members", "supertypes"))
def refused_bequest(facts, t):
    """Overrides with an empty body of base methods with a body, in one file."""
    m = facts["members"].filter("kind = 'method'")
    sub, base = m.filter("is_empty").select("file", "type", "name"), m.filter("NOT is_empty").select("file", F.col("type").alias("base"), "name")
    g = sub.join(facts["supertypes"].select("file", "type", "base"), ["file", "type"]).join(base, ["file", "base", "name"]).groupBy("file", "type").agg(F.count_distinct("name").alias("n"))
    return findings(g, "refused-bequest", 45 + F.col("n") * 15, symbol="type", nullified="n")


@detector("temporary-field", FILE, "mantenibilidad", ("field_events",))
def temporary_field(facts, t):
    e = facts["field_events"]
    g = e.groupBy("file", "type", "field").agg(F.max(F.expr("event = 'fill' AND NOT in_constructor")).alias("fills"), F.max(F.expr("event = 'clear' AND NOT in_constructor")).alias("clears"), F.count_distinct(F.expr("CASE WHEN event IN ('fill', 'clear') THEN member END")).alias("methods"), F.count_distinct(F.expr("CASE WHEN event = 'read' THEN member END")).alias("readers"))
    return findings(g.filter("fills AND clears"), "temporary-field", 35 + F.col("methods") * 10 + F.col("readers") * 5, symbol="type", variant=F.col("field"), methods="methods", readers="readers")


@detector("lazy-init-repetida", FILE, "mantenibilidad", ("lazy_guards",), most=1)
def lazy_init_repeated(facts, t):
    g = facts["lazy_guards"].groupBy("file", "type", "field").agg(F.count_distinct("member").alias("n")).filter(F.col("n") > t["most"])
    return findings(g, "lazy-init-repetida", 30 + F.col("n") * 15, symbol="type", variant=F.col("field"), members="n")


@detector("manual-notification", FILE, "mantenibilidad", ("notifications",), places=2)
def manual_notification(facts, t):
    g = facts["notifications"].groupBy("file", "type", "method", "arity", "argument").agg(F.count_distinct("member").alias("n"), F.count_distinct("target").alias("targets")).filter((F.col("n") >= t["places"]) & (F.col("targets") > 1))
    return findings(g, "manual-notification", 30 + F.col("n") * 15, symbol="type", variant=F.col("method"), places="n")


@detector("hard-wired-notification", FILE, "arquitectura", ("notifications",), targets=3)
def hard_wired_notification(facts, t):
    """The same targets notified by hand in several members."""
    s = facts["notifications"].groupBy("file", "type", "member").agg(F.array_sort(F.collect_set("target")).alias("targets")).filter(F.size("targets") >= t["targets"])
    g = s.groupBy("file", "type", "targets").agg(F.count("*").alias("n")).filter("n > 1")
    return findings(g, "hard-wired-notification", 25 + F.col("n") * 10 + F.size("targets") * 5, symbol="type", places="n")


@detector("optional-behavior-flags", FILE, "mantenibilidad", ("capability_uses",), capabilities=2, members=2)
def optional_behavior_flags(facts, t):
    g = facts["capability_uses"].groupBy("file", "type").agg(F.count_distinct("capability").alias("c"), F.count_distinct("member").alias("m")).filter((F.col("c") >= t["capabilities"]) & (F.col("m") >= t["members"]))
    return findings(g, "optional-behavior-flags", 35 + F.col("c") * 8 + F.col("m") * 3, symbol="type", capabilities="c", members="m")


@detector("enumerated-field-dispatch", FILE, None, ("field_tests",), registered=False, members=2, values=2)
def enumerated_field_dispatch(facts, t):
    g = facts["field_tests"].groupBy("file", "type", "field").agg(F.count_distinct("member").alias("m"), F.count_distinct("value").alias("v")).filter((F.col("m") >= t["members"]) & (F.col("v") >= t["values"]))
    return findings(g, "enumerated-field-dispatch", 35 + F.col("m") * 10 + F.col("v") * 5, symbol="type", variant=F.col("field"), members="m", values="v")


@detector("exclusive-dispatch-ladder", FILE, "arquitectura", ("ladder_calls",), arms=4, targets=4)
def exclusive_dispatch_ladder(facts, t):
    g = facts["ladder_calls"].groupBy("file", "fn_name", "ladder_id").agg(F.count_distinct("arm").alias("arms"), F.count_distinct("target").alias("targets"), F.min("line").alias("a")).filter((F.col("arms") >= t["arms"]) & (F.col("targets") >= t["targets"]))
    return findings(g, "exclusive-dispatch-ladder", 30.0, symbol="fn_name", start="a", end="a", arms="arms", targets="targets")


@detector("exposed-container-traversal", FILE, "arquitectura", ("traversals", "doors"), files=3)
def exposed_container_traversal(facts, t):
    """Client files that walk another type's container by position; silent if the owner has a traversal door."""
    s = facts["traversals"].filter(F.col("file") != F.col("owner_file")).join(facts["doors"].select("owner").distinct(), "owner", "left_anti")
    g = s.groupBy("owner", "owner_file").agg(F.count_distinct("file").alias("files"), F.count("*").alias("sites")).filter(F.col("files") >= t["files"])
    return findings(g, "exposed-container-traversal", 30 + F.col("files") * 6 + F.col("sites") * 4, file="owner_file", symbol="owner", files="files", sites="sites")


@detector("homonymous-delegation", FILE, "mantenibilidad", ("member_calls", "members"))
def homonymous_delegation(facts, t):
    own = facts["members"].filter("kind = 'field'").select("file", "type", F.col("name").alias("receiver"))
    c = facts["member_calls"].filter(F.col("member") == F.col("callee")).join(own, ["file", "type", "receiver"], "left_semi").groupBy("file", "type").agg(F.count_distinct("member").alias("n"))
    return findings(c, "homonymous-delegation", 15.0, symbol="type", methods="n")


@detector("homonymous-divergent-sequence", FILE, "mantenibilidad", ("call_sequences", "supertypes"), common=2, calls=3)
def homonymous_divergent_sequence(facts, t):
    """Siblings of a base whose same-named methods share steps and have own ones: steps of all siblings against steps of each."""
    s = facts["call_sequences"].join(facts["supertypes"].select("file", "type", "base"), ["file", "type"]).filter(F.size("calls") >= t["calls"])
    one = s.select("base", "name", "type", "file", F.explode(F.array_distinct("calls")).alias("step"))
    n = s.groupBy("base", "name").agg(F.count_distinct("type").alias("n"), F.min("file").alias("file")).filter("n >= 2")
    steps = one.groupBy("base", "name", "step").agg(F.count_distinct("type").alias("c")).join(n, ["base", "name"])
    g = steps.groupBy("base", "name", "n", "file").agg(F.sum(F.expr("int(c = n)")).alias("common"), F.sum(F.expr("int(c < n)")).alias("own")).filter((F.col("common") >= t["common"]) & (F.col("own") > 0))
    return findings(g, "homonymous-divergent-sequence", 25.0, symbol="base", variant=F.col("name"), common="common", siblings="n")


@detector("repeated-access-control", FILE, "mantenibilidad", ("access_guards", "guard_doors"), places=3)
def repeated_access_control(facts, t):
    g = facts["access_guards"].join(facts["guard_doors"].select("object").distinct(), "object", "left_anti").groupBy("object", "condition").agg(F.count_distinct("file", "fn_name").alias("n"), F.min("file").alias("file")).filter(F.col("n") >= t["places"])
    return findings(g, "repeated-access-control", 45 + F.col("n") * 5, symbol="object", variant=F.col("condition"), places="n")


@detector("repeated-configured-assembly", FILE, "mantenibilidad", ("assemblies",), cap=200, places=3, coincident=3)
def repeated_configured_assembly(facts, t):
    """assemblies: type, site, file, slots map. Slots with one value over all sites, and slots with several."""
    a = facts["assemblies"]
    sites = a.groupBy("type").agg(F.count_distinct("site").alias("places"), F.min("file").alias("file")).filter(F.col("places") >= t["places"])
    slots = a.select("type", "site", F.explode("slots").alias("slot", "value")).groupBy("type", "slot").agg(F.count_distinct("value").alias("v"), F.count_distinct("site").alias("s")).join(sites, "type").filter("s = places")
    g = slots.groupBy("type", "places", "file").agg(F.sum(F.expr("int(v = 1)")).alias("same"), F.sum(F.expr("int(v > 1)")).alias("vary")).filter((F.col("same") >= t["coincident"]) & (F.col("vary") >= 1))
    return findings(g, "repeated-configured-assembly", 25 + F.col("places") * 4 + F.col("same") * 3, symbol="type", places="places", coincident="same")


@detector("recursive-collection-descent", FILE, "mantenibilidad", ("descents", "covered_operations"), operations=2)
def recursive_collection_descent(facts, t):
    """Operations of a class that loop over one own collection and decide leaf or composite; silent where a supertype with several subtypes has them."""
    d = facts["descents"].join(facts["covered_operations"].select("type", "operation").distinct(), ["type", "operation"], "left_anti")
    g = d.groupBy("file", "type", "collection").agg(F.count_distinct("operation").alias("n")).filter(F.col("n") >= t["operations"])
    return findings(g, "recursive-collection-descent", 40 + F.col("n") * 10, symbol="type", variant=F.col("collection"), operations="n")


@detector("feature-envy-intra", FILE, None, ("foreign_uses",), registered=False, atfd=2, laa=1 / 3, dominance=0.5)
def feature_envy_intra(facts, t):
    """foreign_uses: file, method, provider (null: own), member. Many members of one provider, few own."""
    u = facts["foreign_uses"].groupBy("file", "method", "provider").agg(F.count_distinct("member").alias("n"))
    g = u.groupBy("file", "method").agg(F.sum(F.when(F.col("provider").isNotNull(), F.col("n")).otherwise(0)).alias("atfd"), F.sum(F.when(F.col("provider").isNull(), F.col("n")).otherwise(0)).alias("own"), F.max(F.when(F.col("provider").isNotNull(), F.struct("n", "provider"))).alias("top"))
    laa = F.col("own") / (F.col("own") + F.col("atfd"))
    hit = g.filter((F.col("atfd") > t["atfd"]) & (laa < t["laa"]) & (F.col("top.n") / F.col("atfd") >= t["dominance"]))
    return findings(hit, "feature-envy-intra", 40 + F.col("top.n") * 5, symbol="method", variant=F.col("top.provider"), atfd="atfd", laa=laa)
