"""Cohesion, hypotheses from facts, stored types, seeded orders."""

import itertools

import pytest
from pyspark.sql import functions as F

from basalt.functions import seeded
from basalt.operators import detect, detect_inter, detect_intra, diff, extract, hypotheses  # noqa: F401
from basalt.plans import analyze
from basalt.plans.evidence import cohesion, evidence
from basalt.sources import scan


def plain_cohesion(rows):
    out = {}
    for key, group in itertools.groupby(sorted(set(rows)), key=lambda r: r[:2]):
        of = {}
        for *_, member, field in group:
            of.setdefault(member, set()).add(field)
        pairs = list(itertools.combinations(sorted(of), 2))
        left, parts = dict(of), []
        while left:
            part, fields = [min(left)], set(left.pop(min(left)))
            while more := [m for m, f in left.items() if f & fields]:
                for m in more:
                    part.append(m)
                    fields |= left.pop(m)
            parts.append((-len(part), min(part), len(fields)))
        parts.sort()
        out[key] = (sum(bool(of[a] & of[b]) for a, b in pairs) / len(pairs) if pairs else 1.0, -parts[1][0] if len(parts) > 1 else 0, parts[1][2] if len(parts) > 1 else 0)
    return out


def test_cohesion(spark):
    rows = [("f", "A", f"m{i}", f"x{i % 3}") for i in range(9)] + [("f", "A", "m0", "x1"), ("f", "A", "n1", "y1"), ("f", "A", "n2", "y1"), ("f", "A", "n2", "y2")]
    rows += [("f", "B", "only", "x"), ("g", "A", "a", "x"), ("g", "A", "b", "y"), ("g", "A", "a", "x")]
    got = cohesion(spark.createDataFrame(rows, "file string, type string, member string, field string")).collect()
    assert {(r.file, r.type): (pytest.approx(r.tcc), r.cluster_members, r.cluster_fields) for r in got} == plain_cohesion(rows)


def test_missing_evidence_is_reported(spark):
    e = spark.createDataFrame([("f1", "large-class", 0.2, 2), ("f2", "large-class", 0.9, 2), ("f3", "empty-catch", None, None)], "finding_id string, kind string, tcc double, cluster_members int")
    got, coverage = hypotheses.attach(e)
    told = {r.pattern: (r.status, r.missing) for r in coverage.collect()}
    assert told["extract-class"] == ("corrio", ["cluster_fields", "shared_fields"])
    assert told["handle-empty-catch"] == ("sin-evidencia", ["handler_statements", "protected_exits"])
    assert [(r.finding_id, r.pattern, r.confidence, r.checks) for r in got.collect()] == [("f1", "extract-class", "baja", {"fields": None, "isolated": None})]
    with pytest.raises(ValueError, match="handler_statements"):
        hypotheses.build(hypotheses.HYPOTHESES["handle-empty-catch"], e)


JAVA = {
    "shop/Ledger.java": "package shop;\nclass Ledger {\n    private int in;\n    private int out;\n    void pay(int a) { in = in + a; }\n    void owe(int a) { in = in - a; }\n    void send(int a) { out = out + a; }\n    void take(int a) { out = out - a; }\n    void both(Gate gate) { gate.open(); }\n}\n",
    "shop/Gate.java": "package shop;\nclass Gate {\n    private int state;\n    void open() { state = 1; }\n}\n",
} | {f"shop/User{i}.java": f"package shop;\nclass User{i} {{\n    private Gate gate;\n    User{i}() {{\n        Gate made = new Gate();\n        Gate same = made;\n        gate = same;\n    }}\n    void go() {{\n        gate.shut();\n    }}\n}}\n" for i in range(3)}


def test_stored_types_and_hypotheses_end_to_end(spark):
    files = spark.createDataFrame(list(JAVA.items()), "path string, content string")
    kept = scan.classify(files).filter("language IS NOT NULL")
    out = analyze.build_graph(extract.facts_of_files(kept), kept)
    edges = {(r.src.split("#")[-1], r.dst.split("#")[-1], r.kind, r.provenance) for r in out["edges"].collect()}
    assert {(f"User{i}", "Gate", "stores", "resolved") for i in range(3)} <= edges
    assert {(f"User{i}.go", f"User{i}.gate", "invokes-indirect", "inferred") for i in range(3)} <= edges
    assert {r.id for r in out["nodes"].filter("kind = 'carrier'").collect()} == {f"carrier:shop/User{i}.java#User{i}.gate" for i in range(3)}
    found, _ = detect.run_detectors(spark, out, only=("scattered-instantiation", "large-class"), thresholds={"large-class": {"members": 6}})
    assert {(r.detector_id, r.symbol.split("#")[-1]) for r in found.collect()} == {("scattered-instantiation", "Gate"), ("large-class", "Ledger")}
    proposed, coverage = hypotheses.attach(evidence(out, found))
    assert [(r.pattern, r.state, r.checks["fields"]) for r in proposed.filter(F.col("pattern") == "extract-class").collect()] == []  # one field to a cluster
    known = {r.symbol.split("#")[-1]: r for r in evidence(out, found).collect()}
    assert (known["Ledger"].tcc, known["Ledger"].cluster_members, known["Ledger"].cluster_fields) == (pytest.approx(2 / 6), 2, 1)
    assert {r.status for r in coverage.collect()} == {"corrio", "sin-evidencia"}


def test_seeded_orders(spark):
    assert [seeded.fnv1a32(x) for x in ("", "a", "foobar")] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]
    assert [next(seeded.uniform(s)) for s in (0, 1)] == [0.26642920868471265, 0.6270739405881613]
    items = [f"id{i}" for i in range(20)]
    assert sorted(seeded.shuffled(items, 7)) == sorted(items) and seeded.shuffled(items, 7) == seeded.shuffled(items, 7) != seeded.shuffled(items, 8)
    df = spark.createDataFrame([("k", i) for i in items] + [("l", "x")], "kind string, id string").repartition(3)
    got = {(r.kind, r.turn): r.id for r in seeded.sample(df, 5, 42, "repo").collect()}
    assert [got["k", i] for i in range(1, 6)] == seeded.shuffled(sorted(items), seeded.fnv1a32("42:repo:k"))[:5] and got["l", 1] == "x" and len(got) == 6


def test_moved_code_is_carried_over(spark):
    old, new = "int a;\nint f() {\n  return 1; // one\n}\n", "int zero;\nint one;\n\nint f() {\n    return   1;\n}\nint g() {\n  return 2;\n}\n"
    files = lambda rows: spark.createDataFrame(rows, "path string, content string")
    found = lambda rows: spark.createDataFrame(rows, "row int, id string, file string, kind string, start_line int, end_line int")
    b = diff.with_content(found([(1, "x", "a.java", "long", 2, 4), (2, "y", "gone.java", "long", 1, 3), (3, "p", "t.java", "long", 1, 1), (4, "q", "t.java", "long", 2, 2)]), files([("a.java", old), ("t.java", "same();\nsame();\n")]))
    h = diff.with_content(found([(11, "m", "b/renamed.java", "long", 4, 6), (12, "n", "b/renamed.java", "long", 7, 9), (13, "r", "t.java", "long", 5, 5)]), files([("b/renamed.java", new), ("t.java", "\n\n\n\nsame();\n")]))
    assert [tuple(r) for r in diff.pair(b, h, keys=("id", "content_key")).collect()] == [(1, 11, "content_key")]  # ties are refused
    assert b.filter("row = 2").first().content_key is None
    place = lambda rows: spark.createDataFrame(rows, "row int, place string")
    pairs = spark.createDataFrame([(1, 11), (2, 12), (3, 13)], "base_row int, head_row int")
    got = diff.partially_introduced(pairs, place([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "a")]), place([(11, "a"), (11, "b"), (12, "a"), (12, "a"), (12, "z"), (13, "a"), (14, "q")]))
    assert [tuple(r) for r in got.collect()] == [(12, 2)]


def test_unchanged_facts_skip_their_detectors(spark, tmp_path):
    rows = [("a", "f", "A"), ("b", "f", "A"), ("a", "f", "A")]
    table = lambda r: spark.createDataFrame(r, "name string, file string, type string")
    edge = lambda k, n: spark.createDataFrame([("s", f"d{i}", k) for i in range(n)], "src string, dst string, kind string")
    ran = []

    def counting(id, table_name, **more):
        def run(facts, t):
            ran.append(id)
            rows = facts[table_name].filter("kind = 'calls'") if id == "own-calls" else facts[table_name]
            if id == "own-y" and "also" in facts:
                rows = rows.limit(0)
            return detect.findings(rows.groupBy("file" if table_name != "edges" else "kind").count(), id, 1.0, file="file" if table_name != "edges" else "kind", n="count")

        return detect.register(detect.Detector(id, "intra-file", None, (table_name,), run, **more))

    gone = [counting("own-x", "x"), counting("own-y", "y"), counting("own-calls", "edges", reads=("calls",)), counting("own-all", "edges")]
    try:
        def found(facts, version="1", thresholds=None):
            ran.clear()
            only = ("own-x", "own-y", "own-calls", "own-all")
            keep = detect.kept_findings(spark, facts, str(tmp_path / "kept"), version)
            got, _ = detect.run_detectors(spark, facts, only=only, thresholds=thresholds, keep=keep)
            plain, _ = detect.run_detectors(spark, facts, only=only, thresholds=thresholds)
            again = list(ran)
            assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
            return set(again[:-4])

        facts = {"x": table(rows), "y": table(rows[:1]), "edges": edge("calls", 2).unionByName(edge("imports", 3))}
        assert found(facts) == {"own-x", "own-y", "own-calls", "own-all"}
        assert found({**facts, "x": table(rows[::-1]).repartition(3)}) == set()
        assert found({**facts, "x": table(rows[:2])}) == {"own-x"}  # one of equal rows less
        assert found({**facts, "edges": edge("calls", 2).unionByName(edge("imports", 4))}) == {"own-all"}
        assert found(facts, thresholds={"own-y": {"n": 2}}) == {"own-y"}
        assert found({**facts, "also": table(rows[:1])}) == {"own-y"}  # which only asks whether it is there
        assert found(facts, "2") == {"own-x", "own-y", "own-calls", "own-all"}
    finally:
        for g in gone:
            g()
