import datetime

import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F

from basalt.operators import detect, diff, extract, navigate, quality, ranking, resolve
from basalt.plans import analyze, facts, queries
from basalt.sources import cache, scan, sheets
from basalt.streaming import incremental

from .oracle import compare

SF = "/root/testdata/sf0.001"
QUICK = ("edge_merge", "projection_file", "fan_in_out", "instability", "god_component", "long_function", "finding_ids", "score_rank", "groups", "census_diff", "snapshot_compare", "gc_running_sum", "satisfies_division", "precision_gate")


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    assert compare(spark, SF, queries.QUERIES[name], queries.ORACLES[name]) == ""


def test_census_waivers_of_any_number(spark):
    n = 10_050
    base = spark.range(n).selectExpr("concat('k', id) AS key", "1L AS n").unionByName(spark.createDataFrame([("s/a/x", 2), ("s/b/y", 2)], "key string, n long"))
    head = spark.createDataFrame([("s/a/x", 1), ("s/b/y", 1)], "key string, n long")
    w = spark.range(n).selectExpr("concat('k', id) AS key", "'desaparece' AS expected", "0L AS min").unionByName(spark.createDataFrame([("s/*/x", "baja", 1), ("s/b/*", "baja", 2)], "key string, expected string, min long"))
    got = diff.census_diff(base, head, w)
    assert got.count() == n + 2
    assert [r.key for r in got.filter("NOT waived").collect()] == ["s/b/y"]


def test_whole_graph_queries(spark):
    run = lambda name: entry.queries()[name](spark, SF).collect()
    f = facts.facts(spark, SF)
    file = {r.id: r.file for r in f["nodes"].collect()}
    merged = f["edges"].collect()
    assert any(e.weight < 40 for e in merged)
    out, und = {}, {}
    for e in merged:
        a, b = file[e.src], file[e.dst]
        if e.provenance != "ambiguous" and a != b:
            out.setdefault(a, set()).add(b), und.setdefault(a, set()).add(b), und.setdefault(b, set()).add(a)

    def reach(graph, start):
        depth, front = {start: 0}, [start]
        while front:
            new = {y for x in front for y in graph.get(x, ())} - depth.keys()
            depth.update(dict.fromkeys(new, depth[front[0]] + 1))
            front = list(new)
        return depth

    tri = {v: sum(len(und[x] & n) for x in n) // 2 for v, n in und.items()}
    assert {r.id: (r.degree, r.triangles) for r in run("clustering_coefficient_all")} == {v: (len(n), tri[v]) for v, n in und.items()}
    assert {r.id: r.component for r in run("connected_components_all")} == {v: min(reach(und, v)) for v in und}
    to = {v: set(reach(out, v)) for v in und}
    comp = {v: {x for x in to[v] if v in to[x]} for v in und}
    assert {r.id: (r.component, r["size"]) for r in run("scc_cycles_all")} == {v: (min(c), len(c)) for v, c in comp.items() if len(c) > 1}
    up, both = {}, {}
    for e in merged:
        up.setdefault(e.dst, set()).add(e.src), both.setdefault(e.src, set()).add(e.dst), both.setdefault(e.dst, set()).add(e.src)
    assert {r.id: r.depth for r in run("impact_bfs_all")} == {v: d for v, d in reach(up, "part:1").items() if d <= 3}
    assert [r.cost for r in run("path_shortest_all")] == [reach(both, "part:1")["part:100"]]
    brand = {r.p_partkey: r.p_brand for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    m = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        m.setdefault(f"s{r.l_suppkey}", set()).add(brand[r.l_partkey])
    assert {tuple(r) for r in run("satisfies_division_all")} == {(a, b, "ambiguous" if len(m[a]) == len(m[b]) else "inferred") for a in m for b in m if a != b and len(m[b]) >= 2 and m[b] <= m[a]}


def test_entry_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50
    assert entry.entry(spark).count() >= 0


def test_ranking_borders(spark):
    f = spark.createDataFrame([(f"i{k}", "f", "k", None) for k in range(5)] + [(f"j{k}", "g", "k", None) for k in range(4)], "id string, file string, kind string, declared_key string")
    g = {r.id: r.group_id for r in ranking.group_key(f).collect()}
    assert {g[f"i{k}"] for k in range(5)} == {"file|f|k"} and g["j0"] == "one:j0"
    s = spark.createDataFrame([(k, p) for k, p in [("a", "x")] * 3 + [("a", "y")] * 2], "kind string, pattern string")
    assert {r.pattern for r in ranking.rule_of_three(s).collect()} == {"x"}
    c = spark.createDataFrame([("d", "l", "corrio", 1, 0, ["a"]), ("d", "l", "sin-aristas", 2, 1, ["b"])], "detector_id string, language string, status string, units int, findings int, missing array<string>")
    assert tuple(ranking.coverage_rollup(c).first()) == ("d", "l", "sin-aristas", 3, 1, ["a", "b"])


def test_resolution_stages(spark):
    sym = spark.createDataFrame([("s1", "a/x", "go", ["C"], "method", True, True), ("s2", "b/y", "go", [], "function", True, False), ("s3", "a/z", "run", [], "function", True, False), ("s4", "b/z", "run", [], "function", True, False), ("s5", "c/t", "Type", [], "class", True, False)], "id string, file string, name string, container array<string>, family string, exported boolean, member_of_class_like boolean")
    base = dict(role="read", scope=[], qualifier=None, qualifier_is_bare_constant=False, shadowed_locally=False, is_callee=True, in_type_slot=False)
    refs = [dict(ref_id="bare", file="q/f", name="go"), dict(ref_id="const", file="q/f", name="go", qualifier="C", qualifier_is_bare_constant=True), dict(ref_id="self", file="a/x", name="go", qualifier="self", scope=["C", "m"]), dict(ref_id="near", file="a/f", name="run"), dict(ref_id="far", file="q/f", name="run"), dict(ref_id="shadow", file="q/f", name="run", shadowed_locally=True), dict(ref_id="key", file="q/f", name="run", role="key"), dict(ref_id="one", file="q/f", name="Type"), dict(ref_id="recv", file="q/f", name="run", qualifier="obj")]
    df = spark.createDataFrame([base | r for r in refs], "ref_id string, file string, name string, role string, scope array<string>, qualifier string, qualifier_is_bare_constant boolean, shadowed_locally boolean, is_callee boolean, in_type_slot boolean")
    got = {}
    for r in resolve.resolve(df, sym).collect():
        got.setdefault(r.ref_id, []).append((r.stage, r.provenance, r.sym_id))
    assert got["bare"] == [("global-uniqueness", "resolved", "s2")]
    assert got["const"] == [("bare-constant-receiver", "resolved", "s1")]
    assert got["self"] == [("self-receiver", "resolved", "s1")]
    assert got["near"] == [("path-proximity", "inferred", "s3")]
    assert {x[:2] for x in got["far"]} == {("unresolved", "ambiguous")} and len(got["far"]) == 2
    assert {x[:2] for x in got["shadow"]} == {("local-shadow", None)} and {x[:2] for x in got["key"]} == {("syntactic-role", None)}
    assert got["one"] == [("global-uniqueness", "resolved", "s5")] and {x[:2] for x in got["recv"]} == {("typeless-receiver", "ambiguous")}


def test_contexts_stand_for_their_references(spark):
    sym = spark.createDataFrame([(f"s{i}", f"{'ab'[i % 2]}/x{i}", "run", [], "function", True, False) for i in range(6)] + [("t", "a/t", "only", [], "class", True, False)], "id string, file string, name string, container array<string>, family string, exported boolean, member_of_class_like boolean")
    base = dict(role="read", scope=[], qualifier=None, qualifier_is_bare_constant=False, shadowed_locally=False, in_type_slot=False)
    refs = [base | dict(ref_id=f"r{k}", file="q/f", name="only" if k % 2 else "run", is_callee=k % 3 == 0, from_id=f"u{k}") for k in range(12)] + [base | dict(ref_id="lost", file="q/f", name="only", role="key", is_callee=False, from_id="u")]
    df = spark.createDataFrame(refs, "ref_id string, file string, name string, role string, scope array<string>, qualifier string, qualifier_is_bare_constant boolean, shadowed_locally boolean, is_callee boolean, in_type_slot boolean, from_id string")
    few = resolve.contexts(df)
    assert few.count() == 5 and few.agg(F.sum("n_refs")).first()[0] == 13
    told = {(r.stage, r.outcome): r.n for r in resolve.funnel(resolve.resolve_contexts(few, sym)).collect()}
    assert told == {("global-uniqueness", "resolved"): 6, ("unresolved", "ambiguous"): 6, ("syntactic-role", "rejected"): 1}
    edges = {(r.src, r.dst, r.kind, len(r.alternatives or [])) for r in resolve.edges_of(df, sym).collect()}
    assert edges == {(f"u{k}", "t" if k % 2 else "s0", "references" if k % 3 else "calls", 0 if k % 2 else 6) for k in range(12)}


def test_diff_and_navigation(spark):
    cols = "row int, id string, content_key string, location_key string, file string, kind string, start_line int, end_line int"
    b = spark.createDataFrame([(1, "a", "c1", "l1", "f", "k", 1, 2), (2, "b", "c2", "l2", "f", "k", 5, 6), (3, "x", "c3", "l3", "f", "k", 12, 13), (4, "z", "c9", "l9", "g", "k", 1, 1)], cols)
    h = spark.createDataFrame([(11, "a", "c1", "l1", "f", "k", 1, 2), (12, "n", "c2", "l7", "f", "k", 50, 60), (13, "m", "c5", "l5", "f", "k", 10, 20)], cols)
    assert {(r.row, r.side, r.status) for r in diff.compare(b, h).collect()} == {(11, "head", "carried"), (12, "head", "carried"), (13, "head", "introduced"), (3, "base", "absorbed"), (4, "base", "resolved")}
    e = spark.createDataFrame([("a", "b", "calls", "resolved", 1), ("b", "c", "calls", "resolved", 1), ("a", "d", "contains", "declared", 1), ("d", "c", "calls", "resolved", 1), ("s", "t", "extends", "declared", 1), ("u", "s", "implements", "declared", 1)], "src string, dst string, kind string, provenance string, weight long")
    assert tuple(navigate.shortest_path(e, "a", "c").first()) == (2, ["a", "b", "c"])
    assert navigate.shortest_path(e, "c", "a", directed=True).count() == 0
    assert {(r.id, r.depth) for r in navigate.upward(e, spark.createDataFrame([("c",)], "id string"), 2).collect()} == {("c", 0), ("b", 1), ("d", 1), ("a", 2)}
    assert {(r.id, r.depth) for r in navigate.implementations(e, "t").collect()} == {("s", 1), ("u", 2)}
    assert navigate.ego(e, "b").count() == 2
    m = spark.createDataFrame([(f"t{i}", "alphabet") for i in range(6)] + [("t0", "special"), ("t1", "tiny")], "file string, name string")
    assert [tuple(r) for r in navigate.tests_for(m, m).collect()] == [("t0", 1)]


def test_sources_and_cache(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("def f(x):\n    return x\n")
    (tmp_path / "src" / "gen_pb2.py").write_text("x = 1\n")
    (tmp_path / "src" / "mark.py").write_text("# Code generated by tool\n")
    (tmp_path / "src" / "test_a.py").write_text("import a\n")
    (tmp_path / "src" / "node_modules" / "b.js").write_text("1")
    got = {r.path.split("/")[-1]: (r.language, r.excluded) for r in scan.classify(scan.scan(spark, str(tmp_path))).collect()}
    assert got == {"a.py": ("python", None), "gen_pb2.py": ("python", "generated-name"), "mark.py": ("python", "generated-marker"), "test_a.py": ("python", "test")}
    now = datetime.datetime(2024, 1, 15)
    rows = [("r", f"p{i}", f"h{i}", "v1" if i else "v0", 10, now - datetime.timedelta(days=i)) for i in range(20)]
    facts = spark.createDataFrame(rows, "repo_key string, file_path string, content_hash string, analyzer_version string, bytes long, last_used_at timestamp")
    assert {r.file_path for r in cache.collect_garbage(facts, "v1", now, rows=5, most_bytes=35).collect()} == {"p1", "p2", "p3"}
    files = spark.createDataFrame([("r", "p1", "h1"), ("r", "p2", "new")], "repo_key string, file_path string, content_hash string")
    assert [r.file_path for r in cache.hits(facts, files, "v1").collect()] == ["p1"] and [r.file_path for r in cache.misses(facts, files, "v1").collect()] == ["p2"]
    old = spark.createDataFrame([("1", "verdadero", "n"), ("2", "falso", None)], "id string, verdict string, note string")
    new = spark.createDataFrame([("1", "", ""), ("3", "", "")], "id string, verdict string, note string")
    assert {r.id: (r.verdict, r.still_present) for r in sheets.merge_verdicts(old, new).collect()} == {"1": ("verdadero", True), "3": ("", True), "2": ("falso", False)}
    v = spark.createDataFrame([("k", "verdadero"), ("k", "falso"), ("k", "dudoso"), ("l", "falso")], "kind string, verdict string")
    assert {r.kind: (r.judged, r.passes) for r in quality.precision(v, "kind").collect()} == {"k": (2, True), "l": (1, False)}


PY = '''
class Base:
    def run(self, a: int, b: int, c: int, flag=False):
        if flag:
            a.x = 1
        try:
            go()
        except ValueError:
            pass
        return a
        print(b)

class Sub(Base):
    def run(self):
        pass
'''


def test_extract_and_analyze(spark):
    files = spark.createDataFrame([("pkg/m.py", PY), ("pkg/n.py", "from pkg import m\nimport pkg.m\n\ndef go():\n    return m.Base()\n"), ("pkg/bad.py", "def (")], "path string, content string")
    out = analyze.analyze(spark, files)
    found = {(r.detector_id, r.symbol) for r in out["findings"].collect()}
    assert {("boolean-flag-param", "run"), ("argument-mutation", "run"), ("empty-catch", "run"), ("unreachable-code", "run"), ("primitive-obsession", "run"), ("refused-bequest", "Sub")} <= found
    edges = {(r.src, r.dst, r.kind) for r in out["edges"].collect()}
    assert ("file:pkg/n.py", "file:pkg/m.py", "imports") in edges and ("sym:pkg/m.py#Sub", "sym:pkg/m.py#Base", "extends") in edges
    assert ("sym:pkg/m.py#Base.run", "sym:pkg/n.py#go", "calls") in edges
    assert len(extract.SCHEMAS) >= 15


DECIDING = '''
class Shape:
    side: Canvas
    _hidden: int = 0

    @property
    def area(self):
        return self.side

class Canvas:
    def draw(self, pen):
        return pen
    def wipe(self, all_of_it):
        return all_of_it

class Wall:
    def draw(self, pen):
        return pen
    def wipe(self, all_of_it):
        return all_of_it
    def paint(self):
        return Canvas()

class Odd(Canvas):
    def wipe(self, ignored):
        return 1

def choose(shape, unread, a, b, c):
    total: int = 0
    spare: int
    if a:
        total = 1
    if b:
        total += 2
    if c:
        total = total * 3
    if isinstance(shape, Shape):
        return total
    elif isinstance(shape, Canvas):
        return 2
    return each(shape, choose)

def each(value: "Canvas", call):
    return call(value)
'''


def test_python_facts_of_decisions():
    facts = {}
    for kind, row in extract.python_facts("s.py", DECIDING):
        facts.setdefault(kind, []).append(row)
    name = lambda r: r["fn_id"].split("#")[1].split("@")[0]
    used = {(name(r), r["variable"]) for r in facts["uses"]}
    left = {(name(r), r["variable"], r["is_parameter"]) for r in facts["declarations"] if not r["imposed"] and (name(r), r["variable"]) not in used}
    assert left == {("choose", "unread", True), ("choose", "spare", False)}
    assert {name(r) for r in facts["declarations"] if r["imposed"]} == {"Odd.wipe"}
    assert [(r["target"], r["condition_names"]) for r in facts["guarded_assignments"]] == [("total", ["a"]), ("total", ["b"]), ("total", ["c"])]
    assert [(r["subject"], r["form"]) for r in facts["type_tests"]] == [("shape", "escalera")] * 2
    assert {(r["name"], r["kind"], r["exposed"]) for r in facts["members"] if r["type"] == "Shape"} == {("side", "field", True), ("_hidden", "field", False), ("area", "accessor", True)}
    assert {(".".join(r["scope"]), r["type"]) for r in facts["typed_slots"]} == {("Shape", "Canvas"), ("each", "Canvas")}
    for kind, rows in facts.items():
        assert {c.split()[0] for c in extract.SCHEMAS[kind].split(", ")} >= {c for r in rows for c in r}, kind


def test_edges_of_types(spark):
    files = spark.createDataFrame([("pkg/s.py", DECIDING)], "path string, content string")
    kept = scan.classify(files).filter("language IS NOT NULL")
    facts_ = extract.facts_of(extract.extract(kept))
    out = analyze.build_graph(facts_, kept)
    sym = "sym:pkg/s.py#"
    got = {(r.src.replace(sym, ""), r.dst.replace(sym, ""), r.kind, r.provenance) for r in out["edges"].collect() if r.kind in ("instantiates", "carries", "declares-type", "satisfies")}
    assert {("Wall.paint", "Canvas", "instantiates", "resolved"), ("Shape", "Canvas", "declares-type", "declared"), ("each", "Canvas", "declares-type", "declared"), ("Wall", "Canvas", "satisfies", "inferred")} <= got
    assert not any(k == "satisfies" and (a, b) == ("Canvas", "Wall") for a, b, k, _ in got)
    found, _ = detect.run_detectors(spark, out, only=("flag-accumulator", "type-switch", "unused-variable", "scattered-instantiation"), extra=True)
    assert {(r.detector_id, r.symbol) for r in found.collect()} == {("flag-accumulator", "choose"), ("type-switch", "choose"), ("unused-variable", "choose")}


def test_whole_edge_sets(spark):
    """Calls are read once, weigh what is written, and several bases of a name are ambiguous."""
    one = "class Base:\n    pass\n\ndef g(x):\n    return x\n\ndef f(a):\n    g(a); g(a)\n    return g(a)\n\nclass Own(Base):\n    pass\n"
    two, three = "class Base:\n    pass\n", "class Far(Base):\n    pass\n\ndef user():\n    return each(g)\n\ndef each(h):\n    return h\n"
    files = spark.createDataFrame([("p/one.py", one), ("p/two.py", two), ("p/three.py", three)], "path string, content string")
    kept = scan.classify(files).filter("language IS NOT NULL")
    got = analyze.build_graph(extract.facts_of(extract.extract(kept)), kept)["edges"].filter("kind <> 'contains'").collect()
    strip = lambda x: x.replace("sym:p/", "").replace(".py#", ".")
    assert {(strip(r.src), strip(r.dst), r.kind, r.provenance, r.weight) for r in got} == {
        ("one.f", "one.g", "calls", "resolved", 3),
        ("one.Own", "one.Base", "extends", "declared", 1),
        ("three.Far", "one.Base", "extends", "ambiguous", 1),
        ("three.user", "three.each", "calls", "resolved", 1),
        ("three.user", "one.g", "references", "resolved", 1),
        ("three.user", "one.g", "carries", "resolved", 1),
        ("one.Own", "one.Base", "references", "resolved", 1),
        ("three.Far", "one.Base", "references", "ambiguous", 1),
    }


def test_deep_sources_do_not_fail(spark):
    terms = "x = " + "+".join(["1"] * 2000) + "\n"
    ladder = "def f(a):\n    if a == 0:\n        return 0\n" + "".join(f"    elif a == {i}:\n        return {i}\n" for i in range(1, 1500))
    kinds = {}
    for kind, row in extract.python_facts("deep.py", terms + ladder):
        kinds.setdefault(kind, []).append(row)
    assert [(r["chain"], r["branches"], r["max_nesting"]) for r in kinds["functions"]] == [(1500, 1500, 1500)]
    assert len(kinds["returns"]) == 1500 and len(kinds["clones"]) == 1
    files = spark.createDataFrame([("a.py", "python", terms + ladder), ("b.py", "python", "def (")], "path string, language string, content string")
    out = extract.facts_of(extract.extract(files), ("functions", "unparsed"))
    assert out["functions"].count() == 1 and [tuple(r) for r in out["unparsed"].collect()] == [("b.py", "SyntaxError")]


def test_streams(spark, tmp_path):
    src, facts = str(tmp_path / "in"), str(tmp_path / "facts")
    t = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([("a.py", "def f():\n    return 1\n", "r", t)], incremental.FILES).write.mode("append").parquet(src)
    incremental.keep_facts(incremental.file_stream(spark, src), facts, str(tmp_path / "c"), "v1").awaitTermination()
    spark.createDataFrame([("a.py", "def f():\n    return 2\n", "r", t + datetime.timedelta(days=1)), ("b.py", "x = 1\n", "r", t)], incremental.FILES).write.mode("append").parquet(src)
    incremental.keep_facts(incremental.file_stream(spark, src), facts, str(tmp_path / "c"), "v1").awaitTermination()
    got = {r.file_path: r.last_used_at.day for r in spark.read.parquet(facts).collect()}
    assert got == {"a.py": 2, "b.py": 1}
    e = spark.createDataFrame([(t, "x", 1.0, 1), (t + datetime.timedelta(minutes=5), "x", 2.0, 1), (t + datetime.timedelta(hours=2), "x", 4.0, 1)], "ts timestamp, event_type string, value double, user_id int")
    assert sorted(r.value for r in incremental.windowed_counts(e).collect()) == [3.0, 4.0]
    assert sorted(r.n for r in incremental.sessions(e).collect()) == [1, 2]
