"""Fix points and maintained graphs against plain versions."""

import random

import pytest

from basalt.operators import flow, graph, resolve
from basalt.streaming.incremental_graph import Graph


def plain_types(origins, flows, most):
    strength = {"ambiguous": 0, "inferred": 1, "resolved": 2, "declared": 3}
    at = {}
    for s, t, p in origins:
        at.setdefault(s, {})[t] = max(at.get(s, {}).get(t, 0), strength[p])
    fixed = {s for s, _, p in origins if p == "declared"}
    grew = True
    while grew:
        grew = False
        for a, b in flows:
            if b in fixed or a == b:
                continue
            for t, s in list(at.get(a, {}).items()):
                if at.setdefault(b, {}).get(t, -1) < min(s, 1):
                    at[b][t], grew = min(s, 1), True
    names = {v: k for k, v in strength.items()}
    out = set()
    for s, types in at.items():
        out |= {(s, "*", "ambiguous")} if len(types) > most else {(s, t, names[x]) for t, x in types.items()}
    return out


@pytest.mark.parametrize("seed,most", [(1, 3), (2, 8), (3, 1)])
def test_types_reach_what_a_plain_fix_point_says(spark, seed, most):
    r = random.Random(seed)
    sites = [f"s{i}" for i in range(40)]
    origins = [(r.choice(sites), f"T{r.randrange(9)}", r.choice(["declared", "resolved", "ambiguous", "resolved"])) for _ in range(14)]
    flows = [(r.choice(sites), r.choice(sites)) for _ in range(50)] + [("s0", "s1"), ("s1", "s2"), ("s2", "s0"), ("s3", "s3")]
    o = spark.createDataFrame([*origins, (None, "T", "resolved"), ("s1", None, "resolved")], "site string, type string, provenance string")
    got = flow.propagate(o, spark.createDataFrame(flows, "src string, dst string"), most)
    assert {tuple(x) for x in got.collect()} == plain_types(origins, flows, most)


def test_nothing_flows(spark):
    o, f = spark.createDataFrame([], "site string, type string, provenance string"), spark.createDataFrame([("a", "b")], "src string, dst string")
    assert flow.propagate(o, f).count() == 0


SYMBOL = "id string, file string, name string, container array<string>, family string, exported boolean, member_of_class_like boolean"
REFERENCE = "ref_id string, from_id string, file string, name string, role string, scope array<string>, qualifier string, qualifier_is_bare_constant boolean, shadowed_locally boolean, is_callee boolean, in_type_slot boolean"


def rebuilt(spark, symbols, references):
    raw = resolve.edges_of(spark.createDataFrame(references, REFERENCE), spark.createDataFrame(symbols, SYMBOL))
    return {tuple(r) for r in graph.merge_edges(raw.select("src", "dst", "kind", "provenance", "weight")).collect()}


def test_edits_equal_a_rebuild(spark, tmp_path):
    r = random.Random(8)
    names, files = [f"n{i}" for i in range(12)], [f"{d}/f{i}" for d in "ab" for i in range(4)]
    sym = lambda k, f: (f"y{k}", f, r.choice(names), [], r.choice(["function", "class"]), True, False)
    ref = lambda k, f: (f"r{k}", f"u{k % 5}", f, r.choice(names), "read", [], None, False, False, k % 2 == 0, False)
    symbols, references = [sym(k, r.choice(files)) for k in range(20)], [ref(k, r.choice(files)) for k in range(60)]
    kept = Graph(spark, str(tmp_path / "graph"), buckets=16)
    kept.build(spark.createDataFrame(symbols, SYMBOL), spark.createDataFrame(references, REFERENCE))
    assert {tuple(e) for e in kept.edges().collect()} == rebuilt(spark, symbols, references)
    for step in range(3):
        file = files[step]
        gone_s, gone_r = [s for s in symbols if s[1] == file], [x for x in references if x[2] == file]
        new_s = [s if r.random() < 0.5 else (*s[:2], r.choice(names), *s[3:]) for s in gone_s[1:]] + [sym(100 + step, file)]
        new_r = gone_r[: len(gone_r) // 2] + [ref(1000 + 10 * step + i, file) for i in range(3)]
        touched = kept.update(*(spark.createDataFrame(x, t) for x, t in ((gone_s, SYMBOL), (new_s, SYMBOL), (gone_r, REFERENCE), (new_r, REFERENCE))))
        symbols = [s for s in symbols if s[1] != file] + new_s
        references = [x for x in references if x[2] != file] + new_r
        assert 0 < len(touched) < 16
        assert {tuple(e) for e in kept.edges().collect()} == rebuilt(spark, symbols, references)
    before = kept.heads()
    same = [s for s in symbols if s[1] == files[0]]
    none = spark.createDataFrame([], REFERENCE)
    assert kept.update(spark.createDataFrame(same, SYMBOL), spark.createDataFrame(same, SYMBOL), none, none) == [] and kept.heads() == before
