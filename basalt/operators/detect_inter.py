"""Detectors over the graph of a whole corpus: nodes, merged edges, files, clones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import cut
from ..functions.text import common_prefix_length, dirname, segments
from .components import components
from .detect import detector, findings
from .graph import CONSUMER_KINDS, degrees, project, trusted
from .metrics import clustering, instability, scc

INTER = "inter-file"
#: Fixed values shared by the detectors.
MOST_UNSURE, UNSURE_CEILING = 0.5, 35
LEAST_DEGREE, MOST_IMBALANCE, LEAST_FILES = 3, 4, 20


def file_edges(facts, kinds=None) -> DataFrame:
    return project(facts["nodes"], facts["edges"], "file", kinds)


def with_ends(facts, kinds=None, certain: bool = True) -> DataFrame:
    """Edges with the file, folder and family of both ends."""
    n = facts["nodes"]
    e = trusted(facts["edges"]) if certain else facts["edges"]
    e = e.filter(F.col("kind").isin(*kinds)) if kinds else e
    side = lambda p, k: n.select(F.col("id").alias(k), F.col("file").alias(f"{p}_file"), F.col("family").alias(f"{p}_family"))
    return e.join(side("src", "src"), "src").join(side("dst", "dst"), "dst")


def unsure_share() -> Column:
    return F.avg((F.col("provenance") == "inferred").cast("double"))


def ceiling(sev: Column, share: Column, most: int = UNSURE_CEILING) -> Column:
    return F.when(share > MOST_UNSURE, F.least(sev, F.lit(float(most)))).otherwise(sev)


def p95_floor(deg: DataFrame, column: str) -> DataFrame:
    """One row: the value at 0-based rank floor(0.95 n), and n, from the histogram of degrees."""
    h = deg.groupBy(column).agg(F.count("*").alias("c"))
    w = Window.partitionBy(F.lit(0))
    return h.withColumns({"upto": F.sum("c").over(w.orderBy(column)), "n": F.sum("c").over(w)}).filter(F.col("upto") > F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)).agg(F.min(column).alias(f"p95_{column}"), F.max("n").alias(f"n_{column}"))


@detector("god-component", INTER, "arquitectura", ("nodes", "edges"), cap=50, fan_in=8, fan_out=8)
def god_component(facts, t):
    """Files depended on and depending, both above min(floor, own p95), one above the p95, balanced, with behaviour."""
    deg = degrees(project(facts["nodes"], trusted(facts["edges"], inferred=False), "file"))
    deg = deg.join(F.broadcast(p95_floor(deg, "fan_in")), F.lit(True)).join(F.broadcast(p95_floor(deg, "fan_out")), F.lit(True))  # one row each
    low = lambda c: F.when(F.col(f"n_{c}") >= LEAST_FILES, F.greatest(F.lit(LEAST_DEGREE), F.least(F.lit(t[c]), F.col(f"p95_{c}")))).otherwise(F.greatest(F.lit(LEAST_DEGREE), F.lit(t[c])))
    i, o = F.col("fan_in"), F.col("fan_out")
    hit = deg.filter((i >= low("fan_in")) & (o >= low("fan_out")) & ((i >= F.col("p95_fan_in")) | (o >= F.col("p95_fan_out"))) & (F.greatest(i, o) / F.greatest(F.lit(1), F.least(i, o)) <= MOST_IMBALANCE))
    if "family" in facts["nodes"].columns:
        behaves = facts["nodes"].filter(F.col("family").isin("function", "method")).select(F.col("file").alias("id")).distinct()
        hit = hit.join(behaves, "id", "left_semi")
    return findings(hit, "god-component", 40 + F.round((i - low("fan_in") + o - low("fan_out")) * 1.5), file="id", fan_in=i, fan_out=o)


@detector("shotgun-surgery", INTER, None, ("nodes", "edges"), cap=60, registered=False, callers=6, files=4)
def shotgun_surgery(facts, t):
    e = with_ends(facts, ("calls", "references")).filter("src_file <> dst_file")
    g = e.groupBy("dst", "dst_file").agg(F.count_distinct("src").alias("callers"), F.count_distinct("src_file").alias("files")).filter((F.col("callers") >= t["callers"]) & (F.col("files") >= t["files"]))
    return findings(g, "shotgun-surgery", 25 + F.col("files") * 7 + F.least(F.lit(20), F.col("callers")), file="dst_file", symbol="dst", callers="callers", files="files")


@detector("dependency-cycle", INTER, "arquitectura", ("nodes", "edges"), cap=30, size=2)
def dependency_cycle(facts, t):
    """Strongly connected files over trusted edges that lie in several folders; reported by the component's shortest cycle."""
    e = file_edges(facts, ("imports", "extends", "references", "calls"))
    members = scc(e)
    folders = members.withColumn("folder", dirname(F.col("id")))
    g = folders.groupBy("component").agg(F.max("size").alias("size"), F.count_distinct("folder").alias("folders")).filter((F.col("size") >= t["size"]) & (F.col("folders") > 1))
    # Every strongly connected component has a cycle; were one missed, it would stand with its whole size.
    short = g.join(shortest_cycles(e, members), "component", "left").withColumn("length", F.coalesce("length", F.col("size").cast("int")))
    return findings(short, "dependency-cycle", F.greatest(F.lit(15), 40 + F.col("length") * 7), file="component", size="size", length="length")


def shortest_cycles(edges: DataFrame, members: DataFrame) -> DataFrame:
    """component, length of its shortest cycle, by a frontier from every member at once; a component ends at its first closed cycle."""
    m = members.select(F.col("id"), "component")
    inner = edges.join(m.select(F.col("id").alias("src"), "component"), "src").join(m.select(F.col("id").alias("dst"), F.col("component").alias("c2")), "dst").filter("component = c2 AND src <> dst").select("component", "src", "dst").distinct()
    inner = cut(inner)
    front = cut(m.select("component", F.col("id").alias("start"), "id").distinct())
    seen, closed, step = front, front.select("component", F.lit(0).alias("length")).limit(0), 0
    while not front.isEmpty():
        step += 1
        new = cut(inner.join(front.withColumnRenamed("id", "src"), ["component", "src"]).select("component", "start", F.col("dst").alias("id")).distinct())
        back = new.filter("id = start").select("component", F.lit(step).alias("length")).distinct()
        closed = cut(closed.unionByName(back))
        # All starts move in step, so the first cycle that closes in a component is its shortest.
        front = cut(new.join(seen, ["component", "start", "id"], "left_anti").join(closed.select("component"), "component", "left_anti"))
        seen = cut(seen.join(closed.select("component"), "component", "left_anti").unionByName(front))
    return closed


@detector("unstable-dependency", INTER, "arquitectura", ("nodes", "edges"), cap=40, gap=0.3)
def unstable_dependency(facts, t):
    e = project(facts["nodes"], facts["edges"], "folder", ("imports", "extends", "implements"))
    i = instability(e).select("id", "instability")
    j = e.join(i.select(F.col("id").alias("src"), F.col("instability").alias("ia")), "src").join(i.select(F.col("id").alias("dst"), F.col("instability").alias("ib")), "dst").withColumn("gap", F.col("ib") - F.col("ia")).filter(F.col("gap") > t["gap"] + 1e-9)
    return findings(j, "unstable-dependency", F.greatest(F.lit(20), F.round(25 + F.col("gap") * 70)), file="src", variant=F.col("dst"), gap="gap")


@detector("fanout-without-cohesion", INTER, "arquitectura", ("nodes", "edges"), cap=40, fan_out=20, clustering=0.2)
def fanout_without_cohesion(facts, t):
    e = file_edges(facts)
    j = degrees(e).join(clustering(e).select("id", "clustering"), "id").filter((F.col("fan_out") >= t["fan_out"]) & (F.col("clustering") <= t["clustering"]))
    sev = 35 + F.least(F.lit(35.0), (F.col("fan_out") - t["fan_out"]) * 1.5) + F.least(F.lit(30.0), (t["clustering"] - F.col("clustering")) / t["clustering"] * 30)
    return findings(j, "fanout-without-cohesion", F.greatest(F.lit(15), F.round(sev)), file="id", fan_out="fan_out", clustering="clustering")


@detector("divergent-change", INTER, None, ("nodes", "edges"), cap=40, registered=False, fan_out=6, fan_in=2, clustering=0.1, origins=3)
def divergent_change(facts, t):
    e = file_edges(facts)
    origins = with_ends(facts).filter("src_file <> dst_file").groupBy(F.col("src_file").alias("id")).agg(F.count_distinct("src").alias("origins"))
    j = degrees(e).join(clustering(e).select("id", "clustering"), "id").join(origins, "id").filter((F.col("fan_out") >= t["fan_out"]) & (F.col("fan_in") >= t["fan_in"]) & (F.col("clustering") <= t["clustering"]) & (F.col("origins") >= t["origins"]))
    sev = 30 + F.least(F.lit(40), F.col("fan_out") * 2) + F.round((t["clustering"] - F.col("clustering")) / t["clustering"] * 30)
    return findings(j, "divergent-change", F.greatest(F.lit(20), sev), file="id", fan_out="fan_out", fan_in="fan_in", clustering="clustering", origins="origins")


@detector("duplication", INTER, "arquitectura", ("clones",), copies=1)
def duplication(facts, t):
    """Clone groups by fingerprint, without those whose every copy lies inside a copy of a larger group."""
    return findings(clone_groups(facts["clones"], t["copies"]), "duplication", F.col("n") * 12 + F.col("lines") * 1.5, start="a", end="b", variant=F.col("fingerprint"), copies="n", lines="lines")


def clone_groups(clones: DataFrame, copies: int = 1) -> DataFrame:
    g = clones.groupBy("fingerprint").agg(F.count("*").alias("n"), F.max("nodes").alias("nodes"), F.max(F.col("end_line") - F.col("start_line") + 1).alias("lines"), F.min_by("file", F.struct("file", "start_line")).alias("file"), F.min_by("start_line", F.struct("file", "start_line")).alias("a"), F.min_by("end_line", F.struct("file", "start_line")).alias("b"), F.count_distinct("file").alias("files")).filter(F.col("n") > copies)
    inner = clones.join(g.select("fingerprint", "nodes", "n"), ["fingerprint", "nodes"]).select("fingerprint", "file", "start_line", "end_line", "nodes")
    outer = inner.select(F.col("fingerprint").alias("of"), "file", F.col("start_line").alias("sa"), F.col("end_line").alias("sb"), F.col("nodes").alias("more"))
    held = inner.join(outer, "file").filter("sa <= start_line AND sb >= end_line AND more > nodes AND of <> fingerprint").select("fingerprint", "file", "start_line", "end_line").distinct()
    nested = held.groupBy("fingerprint").agg(F.count("*").alias("held")).join(g.select("fingerprint", "n"), "fingerprint").filter("held = n")
    return g.join(nested.select("fingerprint"), "fingerprint", "left_anti")


@detector("distributed-duplication", INTER, "arquitectura", ("clones", "nodes", "edges"), cap=100, components=1)
def distributed_duplication(facts, t):
    e = file_edges(facts)
    c = components(e.select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("id", "file")
    j = facts["clones"].join(c, "file", "left").withColumn("component", F.coalesce("component", "file"))
    g = j.groupBy("fingerprint").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"), F.count_distinct("component").alias("components"), F.max(F.col("end_line") - F.col("start_line") + 1).alias("lines"), (F.count_distinct("normalized") == 1).alias("same"), F.min("file").alias("first")).filter((F.col("n") > 1) & (F.col("files") >= 2) & (F.col("components") > t["components"]))
    sev = 45 + (F.col("components") - 1) * 18 + F.least(F.lit(20), F.floor(F.col("lines") / 8)) + F.when(F.col("same"), 5).otherwise(0)
    return findings(g, "distributed-duplication", F.greatest(F.lit(20), sev), file="first", variant=F.col("fingerprint"), components="components", copies="n")


def _depth(facts, kinds, levels: int) -> DataFrame:
    """File edges that go ``levels`` folders or more below where the paths part, past a populated folder."""
    e = with_ends(facts, kinds).filter("src_file <> dst_file").groupBy("src_file", "dst_file").agg(unsure_share().alias("unsure"))
    a, b = segments(dirname(F.col("src_file"))), segments(dirname(F.col("dst_file")))
    common = common_prefix_length(a, b)
    e = e.withColumns({"common": common, "skipped": F.size(b) - common - 1, "same_tree": common == F.size(a), "boundary": F.array_join(F.slice(b, 1, common + 1), "/")}).filter(F.col("skipped") >= levels)
    layers = facts["nodes"].select(dirname(F.col("file")).alias("boundary")).distinct()
    return e.join(layers, "boundary", "left_semi")


@detector("import-depth-demeter", INTER, "arquitectura", ("nodes", "edges"), cap=150, edge_kinds=("imports",), levels=2)
def import_depth(facts, t):
    d = _depth(facts, ("imports",), t["levels"])
    return findings(d, "import-depth-demeter", F.greatest(F.lit(15), F.least(F.lit(70), 30 + F.col("skipped") * 10 - F.when(F.col("same_tree"), 20).otherwise(0))), file="src_file", variant=F.col("dst_file"), skipped="skipped")


@detector("layer-skip", INTER, "arquitectura", ("nodes", "edges"), cap=150, levels=2)
def layer_skip(facts, t):
    d = _depth(facts, ("calls", "references", "instantiates"), t["levels"]).groupBy(dirname(F.col("src_file")).alias("folder"), "boundary").agg(F.max("skipped").alias("skipped"), F.min("same_tree").alias("same_tree"), F.avg("unsure").alias("unsure"), F.min("src_file").alias("src_file"), F.count("*").alias("n"))
    sev = F.greatest(F.lit(15), 35 + F.col("skipped") * 12 + F.when(F.col("same_tree"), -20).otherwise(5))
    return findings(d, "layer-skip", ceiling(sev, F.col("unsure")), file="src_file", variant=F.col("boundary"), skipped="skipped", edges="n")


@detector("orphan-file", INTER, "arquitectura", ("nodes", "edges", "files"), cap=150)
def orphan_file(facts, t):
    """Files without any edge to another file, with nameable symbols, not mentioned by name in the corpus (``mentions``: name)."""
    e = with_ends(facts, certain=False).filter("src_file <> dst_file AND kind <> 'contains'")
    linked = e.select(F.col("src_file").alias("path")).unionByName(e.select(F.col("dst_file").alias("path"))).distinct()
    named = facts["nodes"].filter("kind = 'symbol'").select(F.col("file").alias("path")).distinct()
    f = facts["files"].select("path").join(linked, "path", "left_anti").join(named, "path", "left_semi")
    if "mentions" in facts:
        f = f.withColumn("name", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")).join(facts["mentions"].select("name").distinct(), "name", "left_anti")
    return findings(f, "orphan-file", 35.0, file="path")


@detector("unused-symbol", INTER, "arquitectura", ("nodes", "edges"), cap=200, library=0.5)
def unused_symbol(facts, t):
    """Functions and types that no edge consumes, not even as an alternative, named once; exposed ones only below the library share."""
    n = facts["nodes"].filter(F.col("family").isin("function", "method", "class"))
    use = facts["edges"].filter(F.col("kind").isin(*CONSUMER_KINDS))
    used = use.filter("src <> dst").select(F.col("dst").alias("id"))
    if "alternatives" in facts["edges"].columns:
        used = used.unionByName(use.select(F.explode("alternatives").alias("id")))
    single = n.groupBy("name").agg(F.count("*").alias("c")).filter("c = 1").select("name")
    idle = n.join(used.distinct(), "id", "left_anti").withColumn("idle", F.lit(True)).select("id", "idle")
    shares = n.filter(~F.col("member_of_class_like")).join(idle, "id", "left").agg(F.avg(F.coalesce(F.col("idle"), F.lit(False)).cast("double")).alias("share"))
    hit = n.join(idle, "id", "left_semi").join(single, "name", "left_semi").join(F.broadcast(shares), F.lit(True)).filter(~F.col("exported") | (F.coalesce("share", F.lit(0.0)) < t["library"])).filter(~F.col("name").rlike("^(__.*__|main|constructor|initialize)$"))
    sev = F.when(F.col("member_of_class_like"), 30).otherwise(55) + F.least(F.lit(15), F.floor((F.col("end_line") - F.col("start_line") + 1) / 10))
    return findings(hit, "unused-symbol", F.when(F.col("exported"), F.greatest(F.lit(15), sev - 15)).otherwise(sev), symbol="name", start="start_line", end="end_line")


@detector("inappropriate-intimacy", INTER, None, ("nodes", "edges"), cap=40, registered=False, breadth=3)
def inappropriate_intimacy(facts, t):
    e = with_ends(facts).filter("src_file <> dst_file AND kind NOT IN ('contains', 'affects')").groupBy("src_file", "dst_file").agg(F.count_distinct("dst").alias("n"), unsure_share().alias("u"))
    b = e.select(F.col("src_file").alias("dst_file"), F.col("dst_file").alias("src_file"), F.col("n").alias("m"), F.col("u").alias("v"))
    j = e.join(b, ["src_file", "dst_file"]).filter("src_file < dst_file").withColumn("both", F.least("n", "m")).filter((F.col("both") >= t["breadth"]) & (dirname(F.col("src_file")) != dirname(F.col("dst_file"))))
    return findings(j, "inappropriate-intimacy", ceiling(F.greatest(F.lit(20), F.least(F.lit(100), 43 + F.col("both") * 6)), (F.col("u") + F.col("v")) / 2), file="src_file", variant=F.col("dst_file"), breadth="both")


@detector("scattered-instantiation", INTER, "arquitectura", ("nodes", "edges"), cap=50, edge_kinds=("instantiates",), sites=3, fan_out=6)
def scattered_instantiation(facts, t):
    """Types made in many files: not in a hierarchy, with behaviour, stored and so shared; files that make many types do not count."""
    e = with_ends(facts, ("instantiates",)).filter("src_file <> dst_file")
    busy = e.groupBy("src_file").agg(F.count_distinct("dst").alias("n")).filter(F.col("n") > t["fan_out"]).select("src_file")
    kin = facts["edges"].filter(F.col("kind").isin("extends", "implements", "mixes-in"))
    family = kin.select(F.col("src").alias("dst")).unionByName(kin.select("dst")).distinct()
    stored = facts["edges"].filter("kind = 'stores'").select("dst").distinct()
    g = e.join(busy, "src_file", "left_anti").join(family, "dst", "left_anti").join(stored, "dst", "left_semi")
    if "type_id" in getattr(facts.get("members"), "columns", ()):
        g = g.join(facts["members"].filter("kind = 'method'").select(F.col("type_id").alias("dst")).distinct(), "dst", "left_semi")
    g = g.groupBy("dst", "dst_file").agg(F.count_distinct("src_file").alias("n")).filter(F.col("n") >= t["sites"])
    return findings(g, "scattered-instantiation", 30 + F.col("n") * 5, file="dst_file", symbol="dst", files="n")


@detector("speculative-abstraction", INTER, None, ("nodes", "edges"), cap=100, registered=False)
def speculative_abstraction(facts, t):
    e = facts["edges"].filter(F.col("kind").isin("extends", "implements"))
    one = e.groupBy("dst").agg(F.count_distinct("src").alias("n"), F.min("src").alias("src")).filter("n = 1")
    made = facts["edges"].filter("kind = 'instantiates'").select("dst").distinct()
    contract = e.select(F.col("dst").alias("src")).distinct()
    j = one.join(made, "dst", "left_anti").join(contract, "src", "left_anti").join(facts["nodes"].select(F.col("id").alias("dst"), "file"), "dst")
    return findings(j, "speculative-abstraction", 45.0, symbol="dst", variant=F.col("src"))


@detector("parallel-hierarchies", INTER, None, ("nodes", "edges"), cap=30, registered=False, size=3)
def parallel_hierarchies(facts, t):
    """Hierarchies of one shape (size, roots, sorted degrees) that refer to each other."""
    e = trusted(facts["edges"]).filter(F.col("kind").isin("extends", "implements")).select("src", "dst").distinct()
    c = components(e.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    deg = degrees(e).join(c, "id")
    shape = deg.groupBy("component").agg(F.count("*").alias("size"), F.concat_ws("|", F.count("*").cast("string"), F.sum((F.col("fan_out") == 0).cast("int")).cast("string"), F.array_join(F.transform(F.array_sort(F.collect_list(F.col("fan_in") + F.col("fan_out"))), lambda x: x.cast("string")), ",")).alias("shape")).filter(F.col("size") >= t["size"])
    cross = facts["edges"].filter(~F.col("kind").isin("extends", "implements", "contains")).join(c.select(F.col("id").alias("src"), F.col("component").alias("ca")), "src").join(c.select(F.col("id").alias("dst"), F.col("component").alias("cb")), "dst").filter("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    j = cross.join(shape.select(F.col("component").alias("a"), F.col("shape").alias("sa"), "size"), "a").join(shape.select(F.col("component").alias("b"), F.col("shape").alias("sb")), "b").filter("sa = sb")
    return findings(j.join(facts["nodes"].select(F.col("id").alias("a"), "file"), "a"), "parallel-hierarchies", 40.0, symbol="a", variant=F.col("b"), size="size")


@detector("concrete-over-abstraction", INTER, "arquitectura", ("nodes", "edges", "members", "member_uses"), cap=150)
def concrete_over_abstraction(facts, t):
    """uses: client file, type, member. Clients whose used members of a class are all in one of its interfaces."""
    used = facts["member_uses"].select("file", "type_id", "member").distinct()
    pair = facts["edges"].filter(F.col("kind").isin("implements", "satisfies")).select(F.col("src").alias("type_id"), F.col("dst").alias("iface")).distinct()
    in_iface = facts["members"].select(F.col("type_id").alias("iface"), F.col("name").alias("member")).distinct().withColumn("hit", F.lit(1))
    g = used.join(pair, "type_id").join(in_iface, ["iface", "member"], "left").groupBy("file", "type_id", "iface").agg(F.count("*").alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits")).filter("n = hits")
    own = facts["nodes"].select(F.col("id").alias("type_id"), F.col("file").alias("own"))
    g = g.join(own, "type_id").filter("own <> file")
    made = with_ends(facts, ("instantiates",)).select(F.col("src_file").alias("file"), F.col("dst").alias("type_id")).distinct()
    return findings(g.join(made, ["file", "type_id"], "left_anti"), "concrete-over-abstraction", 45 + F.least(F.lit(20), F.col("n") * 4), symbol="type_id", variant=F.col("iface"), members="n")


@detector("coupling-without-abstraction", INTER, None, ("nodes", "edges"), cap=50, registered=False, clients=3, share=0.3, ubiquity=0.1, fan_out=60)
def coupling_without_abstraction(facts, t):
    """Pairs of files used together by clients, each a good part of either's users, without a common ancestor."""
    e = file_edges(facts)
    d = degrees(e)
    total = vertices_count(e)
    fit = e.join(d.filter(F.col("fan_out") <= t["fan_out"]).select(F.col("id").alias("src")), "src").join(d.select(F.col("id").alias("dst"), "fan_in"), "dst").join(F.broadcast(total), F.lit(True)).filter(F.col("fan_in") / F.col("n") < t["ubiquity"])
    x = fit.select("src", F.col("dst").alias("a"), F.col("fan_in").alias("fa"))
    g = x.join(x.select("src", F.col("a").alias("b"), F.col("fa").alias("fb")), "src").filter("a < b").groupBy("a", "b", "fa", "fb").agg(F.count("*").alias("c")).filter((F.col("c") >= t["clients"]) & (F.col("c") / F.greatest("fa", "fb") >= t["share"]))
    up = with_ends(facts, ("extends", "implements")).select(F.col("src_file").alias("f"), F.col("dst").alias("anc")).distinct()
    kin = up.withColumnRenamed("f", "a").join(up.withColumnRenamed("f", "b"), "anc").select("a", "b").distinct()
    return findings(g.join(kin, ["a", "b"], "left_anti"), "coupling-without-abstraction", F.least(F.lit(80), 25 + F.least(F.lit(45), F.col("c") * 5)), file="a", variant=F.col("b"), clients="c")


def vertices_count(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct().agg(F.count("*").alias("n"))


@detector("feature-envy-inter", INTER, None, ("nodes", "edges"), cap=100, registered=False, atfd=2, laa=1 / 3, dominance=0.5, ubiquity=0.1)
def feature_envy_inter(facts, t):
    e = with_ends(facts, ("calls", "references"))
    own = e.filter("src_file = dst_file").groupBy("src_file").agg(F.count_distinct("dst").alias("own"))
    out = e.filter("src_file <> dst_file").groupBy("src_file", "dst_file").agg(F.count_distinct("dst").alias("n"))
    files = vertices_count(file_edges(facts))
    users = out.groupBy("dst_file").agg(F.count("*").alias("users")).join(F.broadcast(files.withColumnRenamed("n", "all")), F.lit(True)).filter(F.col("users") / F.col("all") < t["ubiquity"]).select("dst_file")
    g = out.groupBy("src_file").agg(F.sum("n").alias("atfd"), F.max(F.struct("n", "dst_file")).alias("top")).join(own, "src_file", "left")
    laa = F.coalesce("own", F.lit(0)) / (F.coalesce("own", F.lit(0)) + F.col("atfd"))
    hit = g.filter((F.col("atfd") > t["atfd"]) & (laa < t["laa"]) & (F.col("top.n") / F.col("atfd") >= t["dominance"])).withColumn("dst_file", F.col("top.dst_file")).join(users, "dst_file", "left_semi").filter(dirname(F.col("src_file")) != dirname(F.col("dst_file")))
    return findings(hit, "feature-envy-inter", 40 + F.col("atfd") * 5, file="src_file", variant=F.col("dst_file"), atfd="atfd", laa=laa)


@detector("modulo-envy", INTER, None, ("nodes", "edges"), cap=60, registered=False, foreign=2, locality=1 / 3)
def module_envy(facts, t):
    """Symbols that use more members of one foreign unit than of their own; a unit is a file that declares a type, else its folder."""
    typed = facts["nodes"].filter("family = 'class'").select("file").distinct().withColumn("typed", F.lit(True))
    unit = facts["nodes"].join(typed, "file", "left").select("id", "file", F.when(F.col("typed"), F.col("file")).otherwise(dirname(F.col("file"))).alias("unit"))
    e = trusted(facts["edges"]).filter(F.col("kind").isin("calls", "references")).join(unit.select(F.col("id").alias("src"), F.col("unit").alias("su"), F.col("file").alias("src_file")), "src").join(unit.select(F.col("id").alias("dst"), F.col("unit").alias("du")), "dst")
    g = e.groupBy("src", "src_file", "su", "du").agg(F.count_distinct("dst").alias("n"))
    a = g.groupBy("src", "src_file").agg(F.coalesce(F.max(F.when(F.col("su") == F.col("du"), F.col("n"))), F.lit(0)).alias("own"), F.max(F.when(F.col("su") != F.col("du"), F.struct("n", "du"))).alias("top")).filter(F.col("top").isNotNull())
    laa = F.col("own") / (F.col("own") + F.col("top.n"))
    hit = a.filter((F.col("top.n") > t["foreign"]) & (F.col("own") >= 1) & (laa < t["locality"]))
    return findings(hit, "modulo-envy", F.greatest(F.lit(20), F.least(F.lit(85), F.round(30 + F.col("top.n") * 6 + (1 - laa) * 20))), file="src_file", symbol="src", variant=F.col("top.du"), foreign=F.col("top.n"), laa=laa)


@detector("middle-man", INTER, None, ("nodes", "edges", "functions"), registered=False)
def middle_man(facts, t):
    """Functions without branches that forward to one foreign target and are called from other files."""
    e = with_ends(facts, ("calls",)).filter(F.col("provenance") != "inferred")
    out = e.groupBy("src", "src_file").agg(F.count_distinct("dst").alias("n"), F.min("dst_file").alias("to_file"), F.min("dst").alias("to")).filter("n = 1 AND to_file <> src_file")
    users = e.filter("src_file <> dst_file").groupBy(F.col("dst").alias("src")).agg(F.count_distinct("src_file").alias("users"))
    plain = facts["functions"].filter("branches = 0").select(F.col("id").alias("src"))
    return findings(out.join(users, "src").join(plain, "src", "left_semi"), "middle-man", 25 + F.col("users") * 5, file="src_file", symbol="src", variant=F.col("to"), callers="users")


@detector("homonymous-divergent-signature", INTER, None, ("members", "edges"), cap=20, registered=False)
def homonymous_divergent_signature(facts, t):
    up = facts["edges"].filter(F.col("kind").isin("extends", "implements")).select(F.col("src").alias("type_id"), F.col("dst").alias("base")).distinct()
    m = facts["members"].filter("kind = 'method' AND arity IS NOT NULL")
    declared = m.select(F.col("type_id").alias("base"), "name").distinct()
    g = m.join(up, "type_id").join(declared, ["base", "name"], "left_anti").groupBy("base", "name").agg(F.count_distinct("arity").alias("a"), F.count_distinct("type_id").alias("n"), F.min("arity").alias("lo"), F.max("arity").alias("hi"), F.count_distinct("file").alias("files"), F.min("file").alias("file")).filter("a > 1 AND n > 1")
    return findings(g, "homonymous-divergent-signature", 30 + F.col("a") * 6 + (F.col("hi") - F.col("lo")) * 4 + F.when(F.col("files") > 1, 6).otherwise(0), symbol="base", variant=F.col("name"), arities="a")


@detector("homonymous-divergent-construction", INTER, "arquitectura", ("call_sequences", "products", "edges"), siblings=2, steps=2)
def homonymous_divergent_construction(facts, t):
    """Siblings that redeclare a member, share steps and build different products."""
    up = facts["edges"].filter("kind = 'extends'").select(F.col("src").alias("type_id"), F.col("dst").alias("base")).distinct()
    p = facts["products"].join(up, "type_id").groupBy("base", "name").agg(F.count_distinct("type_id").alias("n"), F.count_distinct("product").alias("products"), F.min("file").alias("file")).filter((F.col("n") >= t["siblings"]) & (F.col("products") > 1))
    s = facts["call_sequences"].join(up, "type_id").select("base", "name", "type_id", F.explode(F.array_distinct("calls")).alias("step")).groupBy("base", "name", "step").agg(F.count_distinct("type_id").alias("c")).filter("c >= 2").groupBy("base", "name").agg(F.count("*").alias("steps")).filter(F.col("steps") >= t["steps"])
    return findings(p.join(s, ["base", "name"]), "homonymous-divergent-construction", 30 + F.col("products") * 8, symbol="base", variant=F.col("name"), products="products", steps="steps")


@detector("hardwired-subtype-combination", INTER, "arquitectura", ("choices",), cap=120, sites=3, slots=2, combos=2)
def hardwired_subtype_combination(facts, t):
    """choices: site, file, slot (base), subtype. Pairs of slots that several sites fill with different combinations."""
    c = facts["choices"].select("site", "file", "slot", "subtype").distinct()
    many = c.groupBy("slot").agg(F.count_distinct("subtype").alias("v")).filter("v >= 2").select("slot")
    c = c.join(many, "slot", "left_semi")
    p = c.join(c.select("site", F.col("slot").alias("slot2"), F.col("subtype").alias("subtype2")), "site").filter("slot < slot2")
    g = p.groupBy("slot", "slot2").agg(F.count_distinct("site").alias("sites"), F.count_distinct("file").alias("files"), F.count_distinct(F.struct("subtype", "subtype2")).alias("combos"), F.min("file").alias("file")).filter((F.col("sites") >= t["sites"]) & (F.col("combos") >= t["combos"]) & (F.col("files") >= 2))
    return findings(g, "hardwired-subtype-combination", 25 + 2 * 4 + F.col("sites") * 3, symbol="slot", variant=F.col("slot2"), sites="sites", combinations="combos")


@detector("invariant-scaffold-varying-call", INTER, "arquitectura", ("nodes", "edges"), places=3, shared=3, files=2)
def invariant_scaffold(facts, t):
    """Places that share collaborators and have exactly one callee of their own: callees used by all of the places that meet under the shared set."""
    e = with_ends(facts, ("calls",)).select("src", "src_file", "dst").distinct()
    often = e.groupBy("dst").agg(F.count("*").alias("c"))
    s = e.join(often, "dst").groupBy("src", "src_file").agg(F.array_sort(F.collect_set(F.when(F.col("c") >= t["places"], F.col("dst")))).alias("shared"), F.sum((F.col("c") < t["places"]).cast("int")).alias("own")).filter((F.size("shared") >= t["shared"]) & (F.col("own") == 1))
    g = s.groupBy("shared").agg(F.count("*").alias("n"), F.count_distinct("src_file").alias("files"), F.min("src_file").alias("file"), F.min("src").alias("src")).filter((F.col("n") >= t["places"]) & (F.col("files") >= t["files"]))
    return findings(g, "invariant-scaffold-varying-call", 30 + F.col("n") * 5, symbol="src", variant=F.array_join("shared", ","), places="n")


@detector("optional-construction-combinations", INTER, "arquitectura", ("construction_calls",), cap=200, counts=3, span=3, sites=3)
def optional_construction(facts, t):
    g = facts["construction_calls"].select("type", "file", "site", F.explode("arg_counts").alias("n")).groupBy("type").agg(F.count_distinct("n").alias("counts"), (F.max("n") - F.min("n")).alias("span"), F.count_distinct("site").alias("sites"), F.min("file").alias("file")).filter((F.col("counts") >= t["counts"]) & (F.col("span") >= t["span"]) & (F.col("sites") >= t["sites"]))
    return findings(g, "optional-construction-combinations", 20 + F.col("counts") * 5 + F.col("sites") * 2, symbol="type", counts="counts", sites="sites")


@detector("repeated-absence-check", INTER, "arquitectura", ("null_checks", "neutral_objects"), clients=4)
def repeated_absence_check(facts, t):
    g = facts["null_checks"].join(facts["neutral_objects"].select("collaborator").distinct(), "collaborator", "left_anti").groupBy("collaborator").agg(F.count_distinct("client").alias("n"), F.count_distinct("file").alias("files"), F.min("file").alias("file")).filter((F.col("n") >= t["clients"]) & (F.col("files") > 1))
    return findings(g, "repeated-absence-check", 30 + F.col("n") * 5, symbol="collaborator", clients="n")


@detector("repeated-collaborator-set", INTER, "arquitectura", ("nodes", "edges"), places=3, pieces=4)
def repeated_collaborator_set(facts, t):
    """The same set of callees in several places; silent where a facade with users already calls that set."""
    e = with_ends(facts, ("calls",)).filter("src_file <> dst_file")
    s = e.groupBy("src", "src_file").agg(F.array_sort(F.collect_set("dst")).alias("pieces")).filter(F.size("pieces") >= t["pieces"])
    users = e.groupBy(F.col("dst").alias("src")).agg(F.count_distinct("src_file").alias("u")).filter("u >= 2").select("src")
    facade = s.join(users, "src", "left_semi").select("pieces").distinct()
    g = s.groupBy("pieces").agg(F.count("*").alias("n"), F.count_distinct("src_file").alias("files"), F.min("src_file").alias("file")).filter((F.col("n") >= t["places"]) & (F.col("files") > 1)).join(facade, "pieces", "left_anti")
    return findings(g, "repeated-collaborator-set", 30 + F.col("n") * 5 + F.size("pieces") * 2, variant=F.array_join("pieces", ","), places="n")


def mirror_trees(files: DataFrame, shared: int = 3, share: float = 0.5, bucket: int = 64) -> DataFrame:
    """(a, b): folder pairs with several files of equal names. Names of more than ``bucket`` files say nothing about a pair and are left out by definition."""
    f = files.select(dirname(F.col("path")).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("base")).distinct()
    some = f.groupBy("base").agg(F.count("*").alias("c")).filter((F.col("c") > 1) & (F.col("c") <= bucket)).select("base")
    size = f.groupBy("folder").agg(F.count("*").alias("n"))
    x = f.join(some, "base")
    p = x.withColumnRenamed("folder", "a").join(x.withColumnRenamed("folder", "b"), "base").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("c")).filter(F.col("c") >= shared)
    return p.join(size.select(F.col("folder").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("folder").alias("b"), F.col("n").alias("nb")), "b").filter(F.col("c") / F.least("na", "nb") >= share).select("a", "b", F.col("c").alias("shared"))
