"""Results and amounts of work where tables grow by copies."""

import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa

from basalt.functions import session
from basalt.llm import jaccard_join
from basalt.llm.packed import unpack_sorted
from basalt.operators import braces, diff, flow, graph, navigate, resolve
from basalt.plans import facts, queries


def test_equal_scores_are_ordered_by_id(spark):
    r = random.Random(5)
    counts = [r.randint(1, 9) for _ in range(60)]
    rows = [(1, f"t{i}", 1) for i in range(60)]
    for id in range(2, 42):  # the same numbers under other terms: one score, summed in many orders
        r.shuffle(counts)
        rows += [(id, f"t{i}", c) for i, c in enumerate(counts)]
    got = navigate.find_similar(spark.createDataFrame(rows, "id long, term string, c long"), 1).collect()
    assert [x.id for x in got] == list(range(2, 22))


def test_division_between_classes(spark):
    sets = [{"a", "b"}, {"a", "b", "c"}, {"c"}, {"a", "b", "c", "d"}, {"x", "y"}]
    m = {f"s{i}": sets[i % 5] for i in range(200)}
    members = spark.createDataFrame([(t, x, 0) for t, s in m.items() for x in s], "type string, name string, arity int")
    of, classes = resolve.signature_classes(members)
    assert of.count() == 200 and classes.count() == 5
    assert resolve.satisfying_classes(classes).count() == 7  # 4 with themselves, 3 others: not a row for each of 40 x 40 copies
    want = {(a, b, "ambiguous" if m[a] == m[b] else "inferred") for a in m for b in m if a != b and len(m[b]) >= 2 and m[b] <= m[a]}
    assert sorted(tuple(r) for r in resolve.satisfies(members).collect()) == sorted(want)


def test_entries_of_the_join_are_small():
    r = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 5000, 400)) for _ in range(1500)]
    docs = pa.RecordBatch.from_arrays([pa.array(range(1500), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    prefixes = jaccard_join.Prefixes(np.ones(jaccard_join.SKETCH, np.float32), Fraction(85, 100))
    out = pa.Table.from_batches(jaccard_join._entries(4, prefixes, 4)([docs])).to_pylist()
    n = sum(len(unpack_sorted(x["keys"])) for x in out)
    assert n > 50_000
    assert sum(len(x[c]) for x in out for c in ("keys", "sets", "ids", "sizes")) < 14 * n


def test_texts_are_dealt_before_they_are_tokens(spark):
    files = spark.createDataFrame([("A.java", "class A {\n}\n"), ("B.java", "class B { int f() { return 1; } }\n")], "path string, content string")
    plan = braces.tokens(files)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and 0 < plan.index("posexplode") < plan.index("Exchange")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_of_snapshots_meet_in_one_aggregation(spark):
    rows = lambda r: spark.createDataFrame(r, "src string, dst string, kind string")
    base, head = rows([("a", "b", "calls")] * 2 + [("a", "c", "calls"), ("n", None, "calls")]), rows([("a", "b", "calls"), ("a", "b", "imports"), ("n", None, "calls")])
    got = diff.edge_diff(base, head)
    assert "Join" not in _plan(got) and _plan(got).count("Exchange") == 1
    assert sorted(tuple(r) for r in got.collect()) == [("a", "b", "imports", "added"), ("a", "c", "calls", "removed")]  # a null is equal to itself, as in EXCEPT


def test_pairs_of_files_need_no_merged_edges(spark):
    d = "/root/testdata/sf0.001"
    merged, raw = (facts.facts(spark, d, merged=m) for m in (True, False))
    pairs = lambda f: sorted(tuple(r) for r in facts.all_files(f).select("src", "dst").collect())
    assert pairs(merged) == pairs(raw)
    for q in ("fan_in_out", "risky_files", "orphan_file", "shotgun_surgery", "modulo_envy", "inappropriate_intimacy"):
        assert not re.search(r"keys=\[src#\d+, dst#\d+, kind#\d+\]", _plan(queries.QUERIES[q](spark, d))), q


def test_declarations_that_nothing_tells_apart_are_counted_as_one(spark):
    symbols = spark.createDataFrame([(f"s{i:03}", f"d{i % 3}/f{i}.src", "run", [], "function", True, False) for i in range(300)] + [("m", "d0/own.src", "run", ["A"], "method", True, True)], "id string, file string, name string, container array<string>, family string, exported boolean, member_of_class_like boolean")
    refs = spark.createDataFrame([(f"r{i}", f"d{i}/own.src", "run", "read", ["A"], q, False, False, True, False) for i in range(2) for q in ("self",)], "ref_id string, file string, name string, role string, scope array<string>, qualifier string, qualifier_is_bare_constant boolean, shadowed_locally boolean, is_callee boolean, in_type_slot boolean")
    contexts = resolve.contexts(refs)
    assert resolve._alike(contexts, symbols, None).count() == 4
    assert sum(r.n for r in resolve._alike(contexts, symbols, None).collect()) == 301
    full = resolve.resolve(refs, symbols).groupBy("ref_id").agg({"*": "count", "stage": "min"}).collect()
    assert {r.ref_id: (r["min(stage)"], r["count(1)"]) for r in full}["r0"] == ("self-receiver", 1)


def test_known_types_move_once_a_round(spark):
    rows = spark.createDataFrame([("a", "T", 2, None), ("a", "T", None, 1), ("b", "T", 1, None), ("b", "T", None, 2), ("c", "U", None, 0)], "site string, type string, had int, got int")
    met = flow._met(rows, 1)
    assert _plan(met).count("Exchange") == 1
    assert sorted(tuple(r) for r in met.collect()) == [("a", "T", 2, False), ("b", "T", 2, True), ("c", "U", 0, True)]
    more = rows.unionByName(spark.createDataFrame([("a", "V", None, 1)], rows.schema))
    assert sorted(tuple(r) for r in flow._met(more, 1).collect())[0] == ("a", flow.ANY, 0, True)


def test_shingles_that_occur_once_hide_no_common_ones(monkeypatch):
    monkeypatch.setattr(jaccard_join, "SKETCH_BITS", 8)  # as full as the table of a large corpus
    monkeypatch.setattr(jaccard_join, "SKETCH", 1 << 8)
    r = random.Random(7)
    common = [" ".join(f"c{p}x{i}" for i in range(20)) for p in range(5)]
    texts = [" ".join(f"w{r.random()}" for _ in range(300)) + (f" {common[i % 5]}" if i < 100 else "") for i in range(400)]
    docs = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    rows = pa.Table.from_batches(jaccard_join._first_pass(4, 4)([docs])).to_pandas()
    blocks = rows[rows["range"].notna()]
    counts = jaccard_join._table(x for _, g in blocks.groupby("range") for x in jaccard_join._most(g).itertuples())
    assert len(rows) == 400 + len(blocks) and sorted(set(counts)) == [1, 20]
    sets = jaccard_join.shingle_sets([x.encode() for x in texts], 4)
    shared = lambda table: max(np.unique(np.concatenate([jaccard_join.Prefixes(table, Fraction(4, 5)).keys(s) for s in sets]), return_counts=True)[1])
    assert shared(counts) <= jaccard_join.FEW  # unlike documents form no crowd
    sums = np.bincount((np.concatenate(sets) & np.uint64(255)).astype(np.int64), minlength=256).astype(np.float32)
    assert shared(sums) > jaccard_join.FEW  # the counts of before


def test_suffixes_are_dealt_before_they_are_counted(spark):
    files = spark.createDataFrame([("a/b/x.py",), ("a/c/x.py",), ("a/c/y.ts",), ("a/c/y.py",), ("z.py",)], "path string")
    imports = spark.createDataFrame([("m", "./x"), ("m", "c/x"), ("m", "c/y"), ("n", "c/y"), ("n", "z"), ("o", "z"), ("o", "z"), ("m", "no")], "file string, specifier string")
    got = resolve.import_targets(imports, files)
    plan = _plan(got)
    assert sorted(tuple(r) for r in got.collect()) == [("m", "c/x", "a/c/x.py"), ("m", "c/y", "a/c/y.ts"), ("n", "c/y", "a/c/y.ts"), ("n", "z", "z.py")]
    assert "Broadcast" not in plan
    counted = plan.index("functions=[count(1)")
    assert plan.index("functions=[partial_count(1)") < plan.index("Exchange", counted)  # no task counts all it reads of the files


def test_edges_are_dealt_before_they_are_merged(spark):
    rows = [("a", "b", "calls", "declared", 2, 1), ("a", "b", "calls", "declared", 3, 2), ("a", "b", "calls", "inferred", 9, 4), ("a", "c", "calls", "ambiguous", 1, 1)]
    got = graph.merge_edges(spark.createDataFrame(rows, "src string, dst string, kind string, provenance string, weight long, roles int"))
    plan = _plan(got)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "b", "calls", "declared", 5, 3), ("a", "c", "calls", "ambiguous", 1, 1)]
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and plan.rindex("HashAggregate") < plan.index("Exchange")


def test_token_tables_are_read_in_the_buckets_of_their_files(spark):
    odd = "} class A { int f(int p) { if (p > 1) { } } int z; } }\nint g() { while (true) { if (x) { h(); }\n"  # braces too many and too few
    files = spark.createDataFrame([("A.java", "class A { int f() { class B { int g() { if (a) { return 1; } return 2; } } return 3; } }\n"), ("B.java", odd)], "path string, content string")
    s = braces.Sources(files)
    for df in (s.tokens, s.statements, s.blocks):
        assert "Exchange" not in _plan(df.groupBy("file", "text" if "text" in df.columns else "open").count().join(df.groupBy("file").count(), "file"))
    at = {(r.file, r.text): (r.fn, r.cls, r.nest) for r in s.tokens.filter("text IN ('1', '2', '3', 'z', 'h')").collect()}
    f, b, g = (s.blocks.filter(f"file = 'A.java' AND name = '{n}'").first().open for n in ("f", "B", "g"))
    a = s.blocks.filter("file = 'A.java' AND name = 'A'").first().open
    assert {k[1]: v for k, v in at.items() if k[0] == "A.java"} == {"1": (g, b, 1), "2": (g, b, 0), "3": (f, a, 0)}
    assert at["B.java", "z"] == (None, s.blocks.filter("file = 'B.java' AND name = 'A'").first().open, 0) and at["B.java", "h"] == (None, None, 1)


def test_tables_in_buckets_are_never_broadcast(spark, monkeypatch):
    kept, whole = [], flow.stored_by
    monkeypatch.setattr(flow, "stored_by", lambda df, *a: kept.append(_plan(df)) or whole(df, *a))
    origins = spark.createDataFrame([("a", "T", "declared"), ("b", "U", "resolved")], "site string, type string, provenance string")
    got = flow.propagate(origins, spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "a")], "src string, dst string"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "T", "declared"), ("b", "T", "inferred"), ("b", "U", "resolved"), ("c", "T", "inferred"), ("c", "U", "inferred")]
    assert len(kept) > 3 and not any("Broadcast" in p for p in kept)
    small = session.stored_by(spark.range(5), 2, "id")  # of a few bytes as files
    assert "Broadcast" not in _plan(spark.range(5).join(small.groupBy("id").count(), "id"))


def test_references_move_with_short_keys(spark):
    ref = "ref_id string, from_id string, file string, name string, role string, scope array<string>, qualifier string, qualifier_is_bare_constant boolean, shadowed_locally boolean, is_callee boolean, in_type_slot boolean"
    refs = spark.createDataFrame([(i, "u", f, "run", "read", [], None, False, False, True, False) for i, f in (("r", "a/x"), ("r", "b/x"), ("q", "a/x"))], ref)
    symbols = spark.createDataFrame([("s", "a/y", "run", [], "function", True, False)], "id string, file string, name string, container array<string>, family string, exported boolean, member_of_class_like boolean")
    assert {len(r.context_id) for r in resolve.contexts(refs).collect()} == {16}
    # Of a reference with two contexts the nearer one decides.
    assert sorted(tuple(r) for r in resolve.decisions(refs, symbols).collect()) == [("q", "run", "u", "s", "calls", "resolved", 1), ("r", "run", "u", "s", "calls", "inferred", 1)]
