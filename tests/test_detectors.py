import pytest

from basalt.operators import detect, detect_inter, detect_intra, hypotheses  # noqa: F401

FN = ("fn_id string, file string, name string, language string, start_line int, end_line int, cognitive int, parameters int, chain int, is_constructor boolean, chain_instantiates boolean, is_factory_like boolean, branches int, id string")


def fn(k, **m):
    d = dict(fn_id=k, file="f", name=k, language="py", start_line=1, end_line=10, cognitive=0, parameters=0, chain=0, is_constructor=False, chain_instantiates=False, is_factory_like=False, branches=0, id=k) | m
    return tuple(d.values())


#: detector -> (facts, expected (symbol or file, severity)); each has a case at and below the border.
CASES = {
    "complexity": ({"functions": ([fn("a", cognitive=15), fn("b", cognitive=14)], FN)}, [("a", 30)]),
    "long-function": ({"functions": ([fn("a", end_line=45), fn("b", end_line=44)], FN)}, [("a", 42.5)]),
    "long-parameter-list": ({"functions": ([fn("a", parameters=6), fn("b", parameters=5)], FN)}, [("a", 55)]),
    "conditional-chain": ({"functions": ([fn("a", chain=5, chain_instantiates=True), fn("b", chain=4)], FN)}, [("a", 75)]),
    "many-returns": ({"functions": ([fn("a"), fn("b")], FN), "returns": ([("a",)] * 4 + [("b",)] * 3, "fn_id string")}, [("a", 70)]),
    "boolean-complexity": ({"functions": ([fn("a"), fn("b")], FN), "bool_chains": ([("a", 3, 2, 1), ("b", 2, 2, 1), ("b", 5, 1, 1)], "fn_id string, operators int, families int, line int")}, [("a", 60)]),
    "boolean-flag-param": ({"functions": ([fn("a"), fn("b")], FN), "params": ([("a", "f", "x", True, "bool", False), ("b", "f", "y", True, "bool", False)], "fn_id string, file string, name string, is_boolean boolean, type string, is_primitive boolean"), "conditions": ([("a", "x", True), ("b", "y and z", False)], "fn_id string, text string, is_bare_name boolean")}, [("a", 45)]),
    "argument-mutation": ({"functions": ([fn("a"), fn("b")], FN), "params": ([("a", "x"), ("b", "x")], "fn_id string, name string"), "assignments": ([("a", "x", True), ("b", "z", False)], "fn_id string, base string, is_member boolean")}, [("a", 55)]),
    "empty-catch": ({"handlers": ([("f", "a", 0, 3), ("f", "b", 1, 5)], "file string, fn_name string, statements int, line int")}, [("a", 55)]),
    "flag-accumulator": ({"functions": ([fn("a"), fn("b")], FN), "guarded_assignments": ([("a", "t", g, [g]) for g in "123"] + [("b", "t", g, ["same"]) for g in "123"], "fn_id string, target string, guard_id string, condition_names array<string>")}, [("a", 76)]),
    "type-switch": ({"functions": ([fn("a"), fn("b")], FN), "type_tests": ([("a", "d", "x", "escalera")] * 2 + [("b", "d", "x", "switch")], "fn_id string, decision_id string, subject string, form string")}, [("a", 61)]),
    "unreachable-code": ({"statements": ([("f", "a", "k", 0, True, True, 1), ("f", "a", "k", 1, False, True, 2), ("f", "a", "k", 2, False, True, 3), ("f", "b", "m", 0, False, True, 1), ("f", "b", "m", 1, True, True, 2)], "file string, fn_name string, block_id string, ordinal int, is_jump boolean, is_executable boolean, line int")}, [("a", 65)]),
    "demeter-chain": ({"functions": ([fn("a")], FN), "access_chains": ([("a", 4, 1), ("a", 3, 2)], "fn_id string, links int, line int")}, [("a", 50)]),
    "unused-variable": ({"functions": ([fn("a")], FN), "declarations": ([("a", "u", True, False), ("a", "v", False, False), ("a", "w", True, True)], "fn_id string, variable string, is_parameter boolean, imposed boolean"), "uses": ([("a", "v")], "fn_id string, variable string")}, [("a", 25)]),
    "primitive-obsession": ({"functions": ([fn("a"), fn("b")], FN), "params": ([("a", "int", True)] * 3 + [("b", "int", True)] * 2, "fn_id string, type string, is_primitive boolean")}, [("a", 70)]),
    "large-class": ({"members": ([("f", "A")] * 47 + [("f", "B")] * 46, "file string, type string")}, [("A", 87)]),
    "data-class": ({"members": ([("f", "A", "field", True)] * 3 + [("f", "A", "accessor", True)] + [("f", "B", "field", True)] * 3 + [("f", "B", "method", True)], "file string, type string, kind string, exposed boolean")}, [("A", 48)]),
    "repeated-switch": ({"switches": ([("f", "x", 1), ("f", "x", 9), ("f", "y", 3)], "file string, subject string, line int")}, [("f", 60)]),
    "inheritance-family": ({"supertypes": ([("f", "A", "B"), ("f", "C", "B"), ("f", "D", "E")], "file string, type string, base string")}, [("B", 15)]),
    "self-referential-member": ({"members": ([("f", "A", "x", "A"), ("f", "A", "y", "int")], "file string, type string, name string, declared_type string")}, [("A", 15)]),
    "refused-bequest": ({"members": ([("f", "B", "m", "method", False), ("f", "A", "m", "method", True), ("f", "C", "m", "method", False)], "file string, type string, name string, kind string, is_empty boolean"), "supertypes": ([("f", "A", "B"), ("f", "C", "B")], "file string, type string, base string")}, [("A", 60)]),
    "temporary-field": ({"field_events": ([("f", "A", "x", "m", "fill", False), ("f", "A", "x", "n", "clear", False), ("f", "A", "x", "o", "read", False), ("f", "B", "x", "m", "fill", True), ("f", "B", "x", "n", "clear", False)], "file string, type string, field string, member string, event string, in_constructor boolean")}, [("A", 60)]),
    "lazy-init-repetida": ({"lazy_guards": ([("f", "A", "x", "m"), ("f", "A", "x", "n"), ("f", "B", "x", "m")], "file string, type string, field string, member string")}, [("A", 60)]),
    "manual-notification": ({"notifications": ([("f", "A", m, "upd", 1, "e", t) for m in "mn" for t in "pq"] + [("f", "B", "m", "upd", 1, "e", "p")], "file string, type string, member string, method string, arity int, argument string, target string")}, [("A", 60)]),
    "hard-wired-notification": ({"notifications": ([("f", "A", m, "u", 1, "e", t) for m in "mn" for t in "pqr"] + [("f", "B", m, "u", 1, "e", t) for m in "mn" for t in "pq"], "file string, type string, member string, method string, arity int, argument string, target string")}, [("A", 60)]),
    "optional-behavior-flags": ({"capability_uses": ([("f", "A", c, m) for c in "12" for m in "xy"] + [("f", "B", "1", m) for m in "xy"], "file string, type string, capability string, member string")}, [("A", 57)]),
    "enumerated-field-dispatch": ({"field_tests": ([("f", "A", "s", "m", "1"), ("f", "A", "s", "n", "2"), ("f", "B", "s", "m", "1"), ("f", "B", "s", "m", "2")], "file string, type string, field string, member string, value string")}, [("A", 65)]),
    "exclusive-dispatch-ladder": ({"ladder_calls": ([("f", "a", "l", i, f"t{i}", i) for i in range(4)] + [("f", "b", "l", i, "t", i) for i in range(4)], "file string, fn_name string, ladder_id string, arm int, target string, line int")}, [("a", 30)]),
    "exposed-container-traversal": ({"traversals": ([(f"c{i}", "O", "o") for i in range(3)] + [(f"c{i}", "P", "p") for i in range(3)] + [("c1", "Q", "q")], "file string, owner string, owner_file string"), "doors": ([("P",)], "owner string")}, [("O", 60)]),
    "homonymous-delegation": ({"member_calls": ([("f", "A", "run", "inner", "run"), ("f", "A", "go", "inner", "run"), ("f", "B", "run", "other", "run")], "file string, type string, member string, receiver string, callee string"), "members": ([("f", "A", "inner", "field"), ("f", "B", "x", "field")], "file string, type string, name string, kind string")}, [("A", 15)]),
    "homonymous-divergent-sequence": ({"call_sequences": ([("f", "A", "m", ["p", "q", "r"]), ("f", "B", "m", ["p", "q", "s"]), ("f", "C", "n", ["p", "q", "r"])], "file string, type string, name string, calls array<string>"), "supertypes": ([("f", "A", "S"), ("f", "B", "S"), ("f", "C", "S")], "file string, type string, base string")}, [("S", 25)]),
    "repeated-access-control": ({"access_guards": ([("f", f"a{i}", "O", "ok") for i in range(3)] + [("f", f"a{i}", "P", "ok") for i in range(3)], "file string, fn_name string, object string, condition string"), "guard_doors": ([("P",)], "object string")}, [("O", 60)]),
    "repeated-configured-assembly": ({"assemblies": ([("T", f"s{i}", "f", {"a": "1", "b": "2", "c": "3", "d": str(i)}) for i in range(3)] + [("U", f"s{i}", "f", {"a": "1", "b": "2", "c": "3"}) for i in range(3)], "type string, site string, file string, slots map<string,string>")}, [("T", 46)]),
    "recursive-collection-descent": ({"descents": ([("f", "A", "kids", o) for o in "mn"] + [("f", "B", "kids", "m")], "file string, type string, collection string, operation string"), "covered_operations": ([("X", "m")], "type string, operation string")}, [("A", 60)]),
    "feature-envy-intra": ({"foreign_uses": ([("f", "m", "P", x) for x in "abc"] + [("f", "m", None, "o")] + [("f", "n", "P", x) for x in "ab"], "file string, method string, provider string, member string")}, [("m", 55)]),
    "data-clump": ({"functions": ([fn(k) for k in "abc"], FN), "params": ([(k, p) for k in "abc" for p in ("x", "y", "z")], "fn_id string, name string")}, [("f", 69)]),
    "commented-out-code": ({"comment_lines": ([("f", 1, "x = 1;"), ("f", 2, "return x;"), ("f", 9, "y = 2;")], "file string, line int, text string")}, [("f", 33)]),
    "hardwired-subtype-combination": ({"choices": ([(s, f"f{s}", "A", a) for s, a in ((1, "a1"), (2, "a2"), (3, "a1"))] + [(s, f"f{s}", "B", b) for s, b in ((1, "b1"), (2, "b2"), (3, "b1"))], "site int, file string, slot string, subtype string")}, [("A", 42)]),
    "optional-construction-combinations": ({"construction_calls": ([("T", "f", "1", [1]), ("T", "f", "2", [2]), ("T", "f", "3", [4]), ("U", "f", "1", [1, 2, 3])], "type string, file string, site string, arg_counts array<int>")}, [("T", 41)]),
    "repeated-absence-check": ({"null_checks": ([(f"c{i}", f"f{i % 2}", "K") for i in range(4)] + [(f"c{i}", f"f{i % 2}", "L") for i in range(3)], "client string, file string, collaborator string"), "neutral_objects": ([("N",)], "collaborator string")}, [("K", 50)]),
}


@pytest.mark.parametrize("id", sorted(CASES))
def test_detector_borders(spark, id):
    facts = {k: spark.createDataFrame(*v) for k, v in CASES[id][0].items()}
    found, coverage = detect.run_detectors(spark, facts, only=(id,))
    got = sorted((r.symbol or r.file, r.severity) for r in found.collect())
    assert got == CASES[id][1]
    assert coverage.first().status == "corrio"


NODE = "id string, kind string, file string, folder string, name string, family string, exported boolean, member_of_class_like boolean, start_line int, end_line int"
EDGE = "src string, dst string, kind string, provenance string, weight long"


def graph(spark, files, edges):
    n = [(k, "symbol", f, f.rsplit("/", 1)[0] if "/" in f else "", k, fam, False, False, 1, 5) for k, f, fam in files]
    return {"nodes": spark.createDataFrame(n, NODE), "edges": spark.createDataFrame([(a, b, k, "resolved", 1) for a, b, k in edges], EDGE), "files": spark.createDataFrame([(f,) for _, f, _ in files], "path string").distinct()}


def ids(spark, facts, id):
    return sorted((r.symbol or r.file, r.severity) for r in detect.run_detectors(spark, facts, only=(id,))[0].collect())


def test_graph_detectors(spark):
    star = [(f"c{i}", f"d{i}/c", "function") for i in range(6)] + [("hub", "h/hub", "function"), ("lone", "x/lone", "function")]
    f = graph(spark, star, [(f"c{i}", "hub", "calls") for i in range(6)])
    assert ids(spark, f, "shotgun-surgery") == [("hub", 25 + 6 * 7 + 6)]
    assert ids(spark, f, "orphan-file") == [("x/lone", 35)]
    cyc = graph(spark, [("a", "p/a", "function"), ("b", "q/b", "function"), ("c", "p/c", "function")], [("a", "b", "imports"), ("b", "a", "imports"), ("a", "c", "imports"), ("c", "b", "imports")])
    assert ids(spark, cyc, "dependency-cycle") == [("p/a", 54)]
    made = graph(spark, [("T", "t/t", "class")] + [(f"u{i}", f"u{i}/f", "function") for i in range(3)], [(f"u{i}", "T", "instantiates") for i in range(3)] + [("u0", "T", "stores")])
    assert ids(spark, made, "scattered-instantiation") == [("T", 45)]
    spec = graph(spark, [("I", "i", "class"), ("A", "a", "class"), ("J", "j", "class"), ("B", "b", "class"), ("C", "c", "class")], [("A", "I", "implements"), ("B", "J", "implements"), ("C", "J", "implements")])
    assert ids(spark, spec, "speculative-abstraction") == [("I", 45)]
    deep = graph(spark, [("a", "r/a", "function"), ("b", "r/x/y/z/b", "function"), ("m", "r/x/m", "function")], [("a", "b", "imports")])
    assert ids(spark, deep, "import-depth-demeter") == [("r/a", 30 + 20 - 20)]


def test_dependency_cycle_of_any_length_and_start(spark):
    ring = [(f"r{i:02}", f"d{i}/r", "function") for i in range(14)]
    f = graph(spark, ring, [(f"r{i:02}", f"r{(i + 1) % 14:02}", "imports") for i in range(14)])
    assert ids(spark, f, "dependency-cycle") == [("d0/r", min(100, 40 + 14 * 7))]
    # The least file lies on a cycle of four; two others depend on each other.
    f = graph(spark, [(k, f"{k}/f", "function") for k in "abcd"], [("a", "b", "imports"), ("b", "c", "imports"), ("c", "d", "imports"), ("d", "a", "imports"), ("c", "b", "calls")])
    assert ids(spark, f, "dependency-cycle") == [("a/f", 54)]


def test_gates_and_runtime_registration(spark):
    found, coverage = detect.run_detectors(spark, {"functions": spark.createDataFrame([fn("a", cognitive=20)], FN)}, only=("complexity", "duplication", "import-depth-demeter"))
    assert {r.detector_id: r.status for r in coverage.collect()} == {"complexity": "corrio", "duplication": "no-aplicable", "import-depth-demeter": "no-aplicable"}
    one = found.collect()[0]
    assert one.id.startswith("complexity:") and len(one.id) == len("complexity:") + 16 and one.impact == 0.5
    remove = detect.register(detect.Detector("own", "intra-file", None, ("functions",), lambda f, t: detect.findings(f["functions"], "own", 1.0)))
    assert detect.run_detectors(spark, {"functions": spark.createDataFrame([fn("a")], FN)}, only=("own",))[0].count() == 1
    remove()
    assert "own" not in detect.REGISTRY
    assert len(detect.REGISTRY) >= 60 and sum(d.registered for d in detect.REGISTRY.values()) >= 45


def test_hypotheses(spark):
    e = spark.createDataFrame([("f1", "type-switch", 1, 3, 3, False, 2, 5, False), ("f2", "type-switch", 2, 3, 3, False, 2, 5, False), ("f3", "type-switch", 1, 3, 3, False, 0, 2, True)], "finding_id string, kind string, subjects int, values int, arm_operations int, discriminant_is_own_field boolean, similar_places int, arms int, has_strategy_types boolean")
    got = {r.finding_id: (r.state, r.confidence) for r in hypotheses.build(hypotheses.HYPOTHESES["strategy"], e).collect()}
    assert got == {"f1": ("ausente", "media"), "f3": ("ya-aplicado", None)}
    assert len(hypotheses.HYPOTHESES) == 35 and sum(h.registered for h in hypotheses.HYPOTHESES.values()) == 29
    h = spark.createDataFrame([("f", "state", "patron", "ausente"), ("f", "strategy", "patron", "ya-aplicado"), ("g", "state", "patron", "ausente"), ("g", "strategy", "patron", "ya-aplicado")], "finding_id string, pattern string, layer string, state string")
    p = spark.createDataFrame([("f", "state", "x", 1, 5), ("f", "strategy", "x", 4, 9), ("g", "state", "x", 1, 3), ("g", "strategy", "x", 4, 9)], "finding_id string, pattern string, file string, start_line int, end_line int")
    assert sorted((r.finding_id, r.pattern) for r in hypotheses.arbitrate(h, p).collect()) == [("f", "strategy"), ("g", "state"), ("g", "strategy")]
