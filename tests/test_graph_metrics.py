import random

import pytest
from pyspark.sql import functions as F

from basalt.functions import ids, stats, text
from basalt.operators import communities, graph, metrics

EDGE = "src string, dst string, weight long"


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, w) for a, b, w in pairs], EDGE)


def test_merge_prefers_strength_and_adds_equals(spark):
    rows = [("a", "b", "calls", "inferred", 5, 1, ["x"]), ("a", "b", "calls", "declared", 2, 2, None), ("a", "b", "calls", "declared", 3, 4, None), ("a", "b", "references", "ambiguous", 1, 1, ["y", "x"]), ("a", "b", "references", "ambiguous", 1, 2, ["x"])]
    df = spark.createDataFrame(rows, "src string, dst string, kind string, provenance string, weight long, roles int, alternatives array<string>")
    got = {r.kind: r for r in graph.merge_edges(df).collect()}
    assert (got["calls"].provenance, got["calls"].weight, got["calls"].roles) == ("declared", 5, 6)
    assert (got["references"].weight, got["references"].roles, got["references"].alternatives) == (2, 3, ["x", "y"])


def test_projection_drops_self_and_ambiguous(spark):
    n = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("b", "B")], "id string, file string")
    e = spark.createDataFrame([("a1", "a2", "calls", "declared", 1), ("a1", "b", "calls", "resolved", 2), ("a2", "b", "imports", "inferred", 3), ("b", "a1", "calls", "ambiguous", 9)], "src string, dst string, kind string, provenance string, weight long")
    assert [tuple(r) for r in graph.project(n, e, "file").collect()] == [("A", "B", 5)]
    assert [tuple(r) for r in graph.project(n, e, "file", ("imports",)).collect()] == [("A", "B", 3)]
    h = [graph.topology_hash(graph.project(n, e.repartition(k), "file")).first()[0] for k in (1, 3)]
    assert h[0] == h[1]


def test_pagerank_small(spark):
    e = edges(spark, [("a", "b", 1), ("b", "a", 1), ("c", "a", 1), ("c", "b", 3)])
    got = {r.id: r for r in metrics.pagerank(e, spark.createDataFrame([("d",)], "id string")).collect()}
    assert abs(sum(r.pagerank for r in got.values()) - 1) < 1e-9
    assert (got["a"].fan_in, got["c"].fan_out, got["d"].fan_in) == (2, 2, 0)
    ranks = {k: 0.25 for k in "abcd"}
    for _ in range(100):
        lost = ranks["d"]
        ranks = {"a": 0.15 / 4 + 0.85 * (ranks["b"] + ranks["c"] / 4 + lost / 4), "b": 0.15 / 4 + 0.85 * (ranks["a"] + 0.75 * ranks["c"] + lost / 4), "c": 0.15 / 4 + 0.85 * lost / 4, "d": 0.15 / 4 + 0.85 * lost / 4}
    assert all(abs(got[k].pagerank - ranks[k]) < 1e-4 for k in ranks)


def test_components_and_cycles(spark):
    e = edges(spark, [(f"n{i:02}", f"n{i + 1:02}", 1) for i in range(12)] + [("n05", "n02", 1), ("x", "y", 1), ("y", "x", 1), ("y", "z", 1)])
    cc = {r.id: r.component for r in metrics.connected_components(e, spark.createDataFrame([("q",)], "id string")).collect()}
    assert set(cc.values()) == {"n00", "x", "q"} and cc["n12"] == "n00"
    got = {r.id: (r.component, r["size"]) for r in metrics.scc(e).collect()}
    assert got == {"n02": ("n02", 4), "n03": ("n02", 4), "n04": ("n02", 4), "n05": ("n02", 4), "x": ("x", 2), "y": ("x", 2)}
    assert metrics.scc(edges(spark, [("a", "b", 1)])).count() == 0


def test_instability_clustering_louvain(spark):
    e = edges(spark, [("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("a", "d", 1)])
    i = {r.id: r.instability for r in metrics.instability(e).collect()}
    assert i["d"] == 0 and i["a"] == pytest.approx(2 / 3)
    c = {r.id: (r.degree, r.clustering) for r in metrics.clustering(e).collect()}
    assert c["a"] == (3, pytest.approx(1 / 3)) and c["b"] == (2, 1.0) and c["d"] == (1, 0.0)
    two = edges(spark, [(f"{s}{i}", f"{s}{j}", 1) for s in "pq" for i in range(4) for j in range(i + 1, 4)] + [("p0", "q0", 1)])
    g = {r.id: r.community for r in metrics.louvain(two).collect()}
    assert {v for k, v in g.items() if k[0] == "p"} == {"p0"} and {v for k, v in g.items() if k[0] == "q"} == {"q0"}


def test_columns(spark):
    one = spark.range(1)
    row = one.select(text.common_prefix_length(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("c"))).alias("p"), text.path_distance(F.lit("a/b/f"), F.lit("a/c/d/g")).alias("d"), text.identifier_words(F.lit("getHTTPServer_name")).alias("w"), *(x.alias(n) for x, n in zip(stats.wilson(F.lit(8), F.lit(10)), ("lo", "hi"))), text.suffixes(F.lit("x/y/z")).alias("s")).first()
    assert (row.p, row.d) == (1, 3) and set(row.w) == {"http", "server", "name"} and row.s == ["x/y/z", "y/z", "z"]
    assert (round(row.lo, 4), round(row.hi, 4)) == (0.4902, 0.9433)
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 7.0), (4, 9.0)], "id int, v double")
    assert {r.id: r.r for r in stats.percent_rank_of_ties(df, "v", "r").collect()} == {1: pytest.approx(1 / 6), 2: pytest.approx(1 / 6), 3: pytest.approx(2 / 3), 4: 1.0}
    assert tuple(stats.nearest_rank(df, "v", 0.5).first()) == (5.0, 4)
    sym = spark.createDataFrame([("f", [], "a", "function", 1), ("f", [], "a", "function", 5), ("f", ["C"], "m", "method", 2)], "file string, container array<string>, name string, family string, start_line int")
    assert sorted(r.id for r in ids.occurrence(sym).collect()) == ["sym:f#C.m", "sym:f#a", "sym:f#a@2"]
    dup = spark.createDataFrame([("i", "f", 2, 3, "t"), ("i", "f", 1, 3, "t")], "id string, file string, start_line int, end_line int, title string")
    assert {r.start_line: r.id for r in ids.disambiguate(dup).collect()} == {1: "i", 2: "i dup 2"}


def plain_louvain(src: list, dst: list, weight: list, nodes: list) -> dict:
    """Louvain at resolution 1, one vertex after the other in the order of ids."""
    names = sorted(set(nodes))
    at = {v: i for i, v in enumerate(names)}
    adj: list[dict[int, float]] = [dict() for _ in names]
    for a, b, w in zip(src, dst, weight):
        i, j = at[a], at[b]
        if i != j:
            adj[i][j] = adj[i].get(j, 0.0) + w
            adj[j][i] = adj[j].get(i, 0.0) + w
    own = [0.0] * len(names)
    member = list(range(len(names)))
    for _ in range(20):
        k = [sum(d.values()) + 2 * s for d, s in zip(adj, own)]
        m2 = sum(k)
        if m2 == 0:
            break
        com, tot = list(range(len(adj))), k[:]
        moved_any = False
        for _ in range(100):
            moved = False
            for i in range(len(adj)):
                links: dict[int, float] = {}
                for j, w in adj[i].items():
                    links[com[j]] = links.get(com[j], 0.0) + w
                c = com[i]
                tot[c] -= k[i]
                best, gain = c, links.get(c, 0.0) - tot[c] * k[i] / m2
                for d in sorted(links):
                    g = links[d] - tot[d] * k[i] / m2
                    if g > gain + 1e-12:
                        best, gain = d, g
                tot[best] += k[i]
                if best != c:
                    com[i], moved, moved_any = best, True, True
            if not moved:
                break
        if not moved_any:
            break
        order = {c: n for n, c in enumerate(sorted(set(com)))}
        new_adj: list[dict[int, float]] = [dict() for _ in order]
        new_own = [0.0] * len(order)
        for i, d in enumerate(adj):
            a = order[com[i]]
            new_own[a] += own[i]
            for j, w in d.items():
                b = order[com[j]]
                if a == b:
                    new_own[a] += w / 2
                else:
                    new_adj[a][b] = new_adj[a].get(b, 0.0) + w
        member = [order[com[c]] for c in member]
        adj, own = new_adj, new_own
    least: dict[int, str] = {}
    for v, c in zip(names, member):
        least.setdefault(c, v)
    return {v: least[c] for v, c in zip(names, member)}


def plain_modularity(links, community):
    m2, inside, total = 0.0, 0.0, {}
    for a, b, w in links:
        if a != b:
            m2 += 2 * w
            inside += 2 * w * (community[a] == community[b])
            for v in (a, b):
                total[community[v]] = total.get(community[v], 0.0) + w
    return inside / m2 - sum(t * t for t in total.values()) / (m2 * m2)


def clique(name, n, w=1):
    return [(f"{name}{i}", f"{name}{j}", w) for i in range(n) for j in range(i + 1, n)]


def test_louvain_on_the_whole_graph(spark):
    """Disconnected graphs are resolved with the weight of the whole, as the plain version does."""
    ring = [x for k in "abcdef" for x in clique(k, 5)] + [("a0", "b1", 1), ("b0", "c1", 1), ("c0", "d1", 1), ("d0", "e1", 1), ("e0", "f1", 1), ("f0", "a1", 1)]
    pairs = [("p0", "p1", 1), ("p1", "p2", 1), ("q0", "q1", 3), ("z", "z", 9)]
    for links in (ring, [*clique("x", 4), *clique("y", 6, 2), *pairs], [*ring, *pairs, *clique("w", 8)]):
        df = edges(spark, links)
        found = metrics.louvain(df)
        got = {r.id: r.community for r in found.collect()}
        src, dst, w = zip(*links)
        want = plain_louvain(list(src), list(dst), list(w), [*src, *dst])
        assert got == want
        assert communities.modularity(df, found) == pytest.approx(plain_modularity(links, want))
    assert metrics.louvain(edges(spark, [("a", "a", 2)])).collect() == [("a", "a")] and metrics.louvain(edges(spark, []), spark.createDataFrame([("s",)], "id string")).collect() == [("s", "s")]


def test_louvain_is_as_good_as_one_by_one(spark):
    r = random.Random(3)
    links = [(f"v{a:02}", f"v{b:02}", r.randrange(1, 5)) for a, b in {tuple(sorted(r.sample(range(24), 2))) for _ in range(40)}]
    links += [(f"v{a:02}", f"v{b:02}", 9) for g in range(3) for a in range(g * 8, g * 8 + 8) for b in range(a + 1, g * 8 + 8) if r.random() < 0.5]
    df = edges(spark, links)
    got = {x.id: x.community for x in metrics.louvain(df).collect()}
    src, dst, w = zip(*links)
    assert plain_modularity(links, got) >= plain_modularity(links, plain_louvain(list(src), list(dst), list(w), [*src, *dst])) - 0.02
    assert all(got[c] == c and min(v for v in got if got[v] == c) == c for c in set(got.values()))
