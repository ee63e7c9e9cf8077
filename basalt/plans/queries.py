"""Queries over the test tables, one to an operator, each beside its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.session import checkpoint_dir, table
from ..operators import braces, detect, diff, flow, graph, metrics, navigate, quality, ranking, resolve
from ..operators import detect_inter, detect_intra  # noqa: F401  they register detectors
from ..sources import cache
from ..streaming import incremental_graph as incremental_graph_module
from . import facts as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def q(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


def g(select: str) -> str:
    return f"WITH RECURSIVE {fx.SQL} {select}"


@q("god_component", g(""", b AS (SELECT a.file AS src, b.file AS dst FROM merged e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE provenance IN ('declared', 'resolved') AND a.file <> b.file GROUP BY ALL),
d AS (SELECT id, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT src AS id, 0 AS i, 1 AS o FROM b UNION ALL SELECT dst, 1, 0 FROM b) GROUP BY id),
p AS (SELECT (list_sort(list(fan_in)))[1 + least(floor(0.95 * count(*)), count(*) - 1)::INT] AS pi, (list_sort(list(fan_out)))[1 + least(floor(0.95 * count(*)), count(*) - 1)::INT] AS po, count(*) AS n FROM d),
t AS (SELECT d.*, pi, po, CASE WHEN n >= 20 THEN greatest(3, least(8, pi)) ELSE 8 END AS ti, CASE WHEN n >= 20 THEN greatest(3, least(8, po)) ELSE 8 END AS tout FROM d, p),
h AS (SELECT id, fan_in, fan_out, least(100, 40 + round((fan_in - ti + fan_out - tout) * 1.5))::DOUBLE AS severity FROM t
  WHERE fan_in >= ti AND fan_out >= tout AND (fan_in >= pi OR fan_out >= po) AND greatest(fan_in, fan_out) / greatest(1, least(fan_in, fan_out)) <= 4 AND id IN (SELECT file FROM nodes WHERE family = 'function'))
SELECT id AS file, severity, fan_in, fan_out FROM h ORDER BY severity DESC, id LIMIT 50"""))
def god_component(spark, d):
    f, _ = detect.run_detectors(spark, fx.facts(spark, d, merged=False), only=("god-component",))
    m = lambda k: F.element_at("measures", k).cast("long").alias(k)
    return f.select("file", "severity", m("fan_in"), m("fan_out"))


@q("edge_merge", g("SELECT * FROM merged"))
def edge_merge(spark, d):
    return graph.merge_edges(fx.edges(spark, d)).select("src", "dst", "kind", "provenance", "weight", "roles")


@q("projection_file", g("SELECT * FROM fe"))
def projection_file(spark, d):
    f = fx.facts(spark, d)
    return graph.project(f["nodes"], f["edges"], "file")


@q("projection_module", g("SELECT * FROM me"))
def projection_module(spark, d):
    f = fx.facts(spark, d)
    return graph.project(f["nodes"], f["edges"], "folder", ("imports",))


@q("fan_in_out", g("SELECT * FROM deg"))
def fan_in_out(spark, d):
    f = fx.facts(spark, d, merged=False)
    return graph.degrees(graph.project(f["nodes"], f["edges"], "file"))


@q("trusted_edges", g("SELECT provenance, count(*) AS edges, sum(weight)::BIGINT AS weight FROM merged WHERE provenance IN ('declared', 'resolved') GROUP BY ALL"))
def trusted_edges(spark, d):
    return graph.trusted(fx.facts(spark, d)["edges"], inferred=False).groupBy("provenance").agg(F.count("*").alias("edges"), F.sum("weight").cast("long").alias("weight"))


@q("edge_census", g("SELECT kind, provenance, count(*) AS edges, sum(weight)::BIGINT AS weight FROM merged GROUP BY ALL"))
def edge_census(spark, d):
    return quality.edge_census(fx.facts(spark, d)["edges"])


@q("contains_edges", g(""", s AS (SELECT DISTINCT p_brand AS a, p_brand || '/' || replace(p_type, ' ', '_') AS b FROM part)
SELECT 'folder:' || a AS src, 'folder:' || b AS dst FROM s UNION ALL SELECT 'folder:' || dir, 'file:' || file FROM nodes"""))
def contains_edges(spark, d):
    return graph.containment(fx.facts(spark, d)["files"]).select("src", "dst")


_INST = """, dd AS (SELECT id, sum(i)::BIGINT AS ca, sum(o)::BIGINT AS ce FROM (SELECT src AS id, 0 AS i, 1 AS o FROM me2 UNION ALL SELECT dst, 1, 0 FROM me2) GROUP BY id), inst AS (SELECT id, ca, ce, ce / (ca + ce)::DOUBLE AS instability FROM dd)"""
_THINMOD = """, me2 AS (SELECT a.folder || ':' || a.module AS src, b.folder || ':' || b.module AS dst, sum(weight)::BIGINT AS weight FROM merged e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE provenance <> 'ambiguous' AND kind = 'imports' AND a.folder || ':' || a.module <> b.folder || ':' || b.module GROUP BY ALL)"""


def _fine_modules(spark, d):
    f = fx.facts(spark, d)
    f["nodes"] = f["nodes"].withColumn("folder", F.concat_ws(":", "folder", "module"))
    return f


@q("instability", g(_THINMOD + _INST + " SELECT id, ca, ce, round(instability, 9) AS instability FROM inst"))
def instability(spark, d):
    f = _fine_modules(spark, d)
    return metrics.instability(graph.project(f["nodes"], f["edges"], "folder", ("imports",))).select("id", "ca", "ce", F.round("instability", 9).alias("instability"))


@q("unstable_dependency", g(_THINMOD + _INST + """, gaps AS (SELECT e.src, e.dst, b.instability - a.instability AS gap FROM me2 e JOIN inst a ON a.id = e.src JOIN inst b ON b.id = e.dst)
SELECT src AS file, dst AS variant, greatest(20, least(100, round(25 + gap * 70)))::DOUBLE AS severity FROM gaps WHERE gap > 0.3 + 1e-9 ORDER BY severity DESC, concat_ws('#', src, dst) LIMIT 40"""))
def unstable_dependency(spark, d):
    f, _ = detect.run_detectors(spark, _fine_modules(spark, d), only=("unstable-dependency",))
    return f.select("file", "variant", "severity")


_TRI = """, k AS (SELECT a AS id, count(*) AS degree FROM und GROUP BY a), tri AS (SELECT x.a AS id, count(*) / 2 AS t FROM und x JOIN und y ON x.b = y.a JOIN und z ON y.b = z.a AND z.b = x.a GROUP BY x.a)"""


@q("clustering_coefficient", g(_TRI + " SELECT id, degree, coalesce(t, 0)::BIGINT AS triangles, round(CASE WHEN degree < 2 THEN 0.0 ELSE 2.0 * coalesce(t, 0) / (degree * (degree - 1)) END, 9)::DOUBLE AS clustering FROM k LEFT JOIN tri USING (id)"))
def clustering_coefficient(spark, d):
    return metrics.clustering(fx.thin(fx.facts(spark, d))).select("id", "degree", "triangles", F.round("clustering", 9).alias("clustering"))


@q("clustering_coefficient_all")
def clustering_coefficient_all(spark, d):
    """Without the filter on weights; beyond SQL at size, tested against brute force. So are the other queries named ``_all``."""
    return metrics.clustering(fx.all_files(fx.facts(spark, d, merged=False))).select("id", "degree", "triangles", F.round("clustering", 9).alias("clustering"))


@q("connected_components", g(", r(a, b) AS (SELECT a, a FROM und UNION SELECT r.a, und.b FROM r JOIN und ON und.a = r.b) SELECT a AS id, min(b) AS component FROM r GROUP BY a"))
def connected_components(spark, d):
    return metrics.connected_components(fx.thin(fx.facts(spark, d)))


@q("connected_components_all")
def connected_components_all(spark, d):
    return metrics.connected_components(fx.all_files(fx.facts(spark, d, merged=False)))


@q("scc_cycles", g(""", r(a, b) AS (SELECT src, dst FROM thin UNION SELECT r.a, t.dst FROM r JOIN thin t ON t.src = r.b),
c AS (SELECT x.a AS id, least(x.a, min(x.b)) AS component, count(*) AS size FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a) SELECT id, component, size FROM c WHERE size >= 2"""))
def scc_cycles(spark, d):
    return metrics.scc(fx.thin(fx.facts(spark, d)))


@q("scc_cycles_all")
def scc_cycles_all(spark, d):
    return metrics.scc(fx.all_files(fx.facts(spark, d, merged=False)))


def trade(spark, d):
    """Nation to nation: who buys from whom."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("long").alias("w"))
    o, c, s = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "supplier")
    return li.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src")), "o_custkey").join(s.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst")), "l_suppkey").filter("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("weight"))


_TRADE = """trade AS (SELECT c_nationkey AS src, s_nationkey AS dst, sum(CAST(l_quantity AS BIGINT))::DOUBLE AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL),
v AS (SELECT src AS id FROM trade UNION SELECT dst FROM trade), n AS (SELECT count(*) AS n FROM v), tot AS (SELECT src, sum(weight) AS total FROM trade GROUP BY src), share AS (SELECT t.src, dst, weight / total AS s FROM trade t JOIN tot USING (src))"""


def _pagerank_sql(rounds: int) -> str:
    out = f"WITH {_TRADE}, r0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM v, n)"
    for i in range(rounds):
        out += f""", l{i} AS (SELECT coalesce(sum(r), 0) AS lost FROM r{i} WHERE id NOT IN (SELECT src FROM tot)),
r{i + 1} AS (SELECT a.id, 0.15 / n + 0.85 * (coalesce(g.x, 0) + lost / n) AS r FROM r{i} a CROSS JOIN n CROSS JOIN l{i} LEFT JOIN (SELECT dst, sum(s * r) AS x FROM share JOIN r{i} ON id = src GROUP BY dst) g ON g.dst = a.id)"""
    return out + f" SELECT id, round(r, 9)::DOUBLE AS pagerank FROM r{rounds}"


@q("pagerank_k10", _pagerank_sql(10))
def pagerank_k10(spark, d):
    return metrics.pagerank(trade(spark, d), iterations=10).select("id", F.round("pagerank", 9).alias("pagerank"))


@q("louvain")
def louvain(spark, d):
    e = trade(spark, d)
    return metrics.louvain(e.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "weight"))


@q("topology_hash")
def topology_hash(spark, d):
    f = fx.facts(spark, d)
    return graph.topology_hash(graph.project(f["nodes"], f["edges"], "file"))


_ENDS = ", ends AS (SELECT e.*, a.file AS sf, b.file AS df, a.dir AS sd, b.dir AS dd FROM merged e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst)"


@q("shotgun_surgery", g(_ENDS + """, h AS (SELECT dst, df, count(DISTINCT src) AS callers, count(DISTINCT sf) AS files FROM ends WHERE provenance <> 'ambiguous' AND kind IN ('calls', 'references') AND sf <> df GROUP BY ALL HAVING callers >= 6 AND files >= 4)
SELECT df AS file, dst AS symbol, least(100, 25 + files * 7 + least(20, callers))::DOUBLE AS severity FROM h ORDER BY severity DESC, concat_ws('#', df, dst) LIMIT 60"""))
def shotgun_surgery(spark, d):
    f, _ = detect.run_detectors(spark, fx.facts(spark, d, merged=False), only=("shotgun-surgery",))
    return f.select("file", "symbol", "severity")


@q("fanout_without_cohesion", g(""", und2 AS (SELECT src AS a, dst AS b FROM fe UNION SELECT dst, src FROM fe), k AS (SELECT a AS id, count(*) AS degree FROM und2 GROUP BY a),
tri AS (SELECT x.a AS id, count(*) / 2 AS t FROM und2 x JOIN und2 y ON x.b = y.a JOIN und2 z ON y.b = z.a AND z.b = x.a GROUP BY x.a),
j AS (SELECT id, fan_out, 2.0 * coalesce(t, 0) / (degree * (degree - 1)) AS c FROM deg JOIN k USING (id) LEFT JOIN tri USING (id) WHERE degree >= 2)
SELECT id AS file, greatest(15, least(100, round(35 + least(35, (fan_out - 20) * 1.5) + least(30, (0.2 - c) / 0.2 * 30))))::DOUBLE AS severity, fan_out FROM j WHERE fan_out >= 20 AND c <= 0.2 ORDER BY severity DESC, id LIMIT 40"""))
def fanout_without_cohesion(spark, d):
    f, _ = detect.run_detectors(spark, fx.facts(spark, d, merged=False), only=("fanout-without-cohesion",))
    return f.select("file", "severity", F.element_at("measures", "fan_out").cast("long").alias("fan_out"))


@q("inappropriate_intimacy", g(_ENDS + """, w AS (SELECT sf, df, sd, dd, count(DISTINCT dst) AS n FROM ends WHERE provenance <> 'ambiguous' AND sf <> df GROUP BY ALL)
SELECT a.sf AS file, a.df AS variant, least(a.n, b.n)::BIGINT AS breadth FROM w a JOIN w b ON a.sf = b.df AND a.df = b.sf WHERE a.sf < a.df AND least(a.n, b.n) >= 1 AND a.sd <> a.dd"""))
def inappropriate_intimacy(spark, d):
    """Parts are one symbol to a file here, so the breadth of one is asked for."""
    out = detect_inter.inappropriate_intimacy(fx.facts(spark, d, merged=False), {"breadth": 1})
    return out.select("file", "variant", F.element_at("measures", "breadth").cast("long").alias("breadth"))


@q("orphan_file", g(_ENDS + " SELECT file, 35.0::DOUBLE AS severity FROM nodes WHERE file NOT IN (SELECT sf FROM ends WHERE sf <> df UNION SELECT df FROM ends WHERE sf <> df) ORDER BY file LIMIT 150"))
def orphan_file(spark, d):
    f, _ = detect.run_detectors(spark, fx.facts(spark, d, merged=False), only=("orphan-file",))
    return f.select("file", "severity")


@q("modulo_envy", g(_ENDS + """, un AS (SELECT id, CASE WHEN family = 'class' THEN file ELSE dir END AS unit FROM nodes), u AS (SELECT e.src, e.sf, a.unit AS su, b.unit AS du, count(DISTINCT e.dst) AS n FROM ends e JOIN un a ON a.id = e.src JOIN un b ON b.id = e.dst
 WHERE provenance <> 'ambiguous' AND kind IN ('calls', 'references') GROUP BY ALL),
t AS (SELECT src, sf, coalesce(max(n) FILTER (su = du), 0) AS own, max(CASE WHEN su <> du THEN (n, du) END) AS top FROM u GROUP BY ALL)
SELECT sf AS file, src AS symbol, own::BIGINT AS own FROM t WHERE top IS NOT NULL AND top[1] > 0 AND own >= 1 AND own / (own + top[1]) <= 0.5"""))
def modulo_envy(spark, d):
    """One foreign member is enough here, at a locality of a half."""
    out = detect_inter.module_envy(fx.facts(spark, d, merged=False), {"foreign": 0, "locality": 0.5 + 1e-12})
    own = F.round(F.element_at("measures", "laa") * F.element_at("measures", "foreign") / (1 - F.element_at("measures", "laa"))).cast("long")
    return out.select("file", "symbol", own.alias("own"))


@q("unused_symbol", g(""", once AS (SELECT name FROM nodes GROUP BY name HAVING count(*) = 1), idle AS (SELECT id FROM nodes WHERE id NOT IN (SELECT dst FROM merged WHERE src <> dst)), sh AS (SELECT avg((id IN (SELECT id FROM idle))::INT::DOUBLE) AS share FROM nodes)
SELECT file, name AS symbol, CASE WHEN exported THEN greatest(15, 55 + least(15, floor(p_size / 10)) - 15) ELSE 55 + least(15, floor(p_size / 10)) END::DOUBLE AS severity FROM nodes, sh WHERE id IN (SELECT id FROM idle) AND name IN (SELECT name FROM once) AND (NOT exported OR share < 0.5) ORDER BY severity DESC, concat_ws('#', file, name) LIMIT 200"""))
def unused_symbol(spark, d):
    f, _ = detect.run_detectors(spark, fx.facts(spark, d), only=("unused-symbol",))
    return f.select("file", "symbol", "severity")


def clones(spark, d):
    """Lines of documents as clone candidates."""
    t = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return t.filter(F.length("line") >= 40).select(F.md5(F.lower("line").cast("binary")).alias("fingerprint"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), F.col("i").alias("start_line"), F.col("i").alias("end_line"), F.length("line").alias("nodes"), F.col("line").alias("normalized"))


_CLONES = "c AS (SELECT md5(lower(line)) AS fp, 'd' || doc_id AS file, i - 1 AS i, length(line) AS nodes FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE length(line) >= 40)"


@q("duplication_groups", f"WITH {_CLONES} SELECT fp AS fingerprint, count(*) AS n, count(DISTINCT file) AS files, least(100, count(*) * 12 + 1.5)::DOUBLE AS severity FROM c GROUP BY fp HAVING count(*) > 1")
def duplication_groups(spark, d):
    c = detect_inter.clone_groups(clones(spark, d))
    return c.select("fingerprint", "n", "files", F.least(F.lit(100.0), F.col("n") * 12 + F.col("lines") * 1.5).alias("severity"))


@q("repeated_switch", """WITH s AS (SELECT 'o' || o_custkey % 100 AS file, o_orderpriority AS subject, o_orderkey AS line FROM orders)
SELECT file, subject AS variant, least(100, 40 + count(*) * 10)::DOUBLE AS severity, min(line)::INTEGER AS start_line FROM s GROUP BY ALL HAVING count(*) > 1""")
def repeated_switch(spark, d):
    s = table(spark, d, "orders").select(F.concat(F.lit("o"), (F.col("o_custkey") % 100).cast("string")).alias("file"), F.col("o_orderpriority").alias("subject"), F.col("o_orderkey").alias("line"))
    return detect_intra.repeated_switch({"switches": s}, {"most": 1}).select("file", "variant", "severity", "start_line")


@q("data_clump", """WITH fnp AS (SELECT l_orderkey AS fn, list_sort(list(DISTINCT 's' || l_suppkey % 4)) AS names, l_orderkey % 50 AS file FROM lineitem GROUP BY l_orderkey)
SELECT 'o' || file AS file, array_to_string(names, ',') AS variant, count(*) AS repeats, least(100, 30 + count(*) * 10 + len(names) * 3)::DOUBLE AS severity FROM fnp WHERE len(names) >= 3 GROUP BY file, names HAVING count(*) >= 3""")
def data_clump(spark, d):
    li = table(spark, d, "lineitem")
    fn = F.col("l_orderkey").cast("string")
    params = li.select(fn.alias("fn_id"), F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string")).alias("name"))
    functions = li.select(fn.alias("fn_id"), F.concat(F.lit("o"), (F.col("l_orderkey") % 50).cast("string")).alias("file"), fn.alias("name"), F.lit(1).alias("start_line")).distinct()
    out = detect_intra.data_clump({"params": params, "functions": functions}, {"group": 3, "repeats": 3})
    return out.select("file", "variant", F.element_at("measures", "repeats").cast("long").alias("repeats"), "severity")


@q("complexity", f"WITH {fx.FUNCTIONS_SQL} SELECT file, symbol, least(100, 30 + (cognitive - 15) * 3)::DOUBLE AS severity FROM fn WHERE cognitive >= 15")
def complexity(spark, d):
    return detect.run_detectors(spark, {"functions": fx.functions(spark, d)}, only=("complexity",))[0].select("file", "symbol", "severity")


@q("long_function", f"WITH {fx.FUNCTIONS_SQL} SELECT file, symbol, least(100, 20 + lines / 2.0)::DOUBLE AS severity FROM fn WHERE lines >= 45")
def long_function(spark, d):
    return detect.run_detectors(spark, {"functions": fx.functions(spark, d)}, only=("long-function",))[0].select("file", "symbol", "severity")


@q("long_parameter_list", f"WITH {fx.FUNCTIONS_SQL} SELECT file, symbol, CASE WHEN rf = 'R' THEN 'constructor' END AS variant, least(100, 25 + parameters * 5)::DOUBLE AS severity FROM fn WHERE parameters >= 6")
def long_parameter_list(spark, d):
    return detect.run_detectors(spark, {"functions": fx.functions(spark, d)}, only=("long-parameter-list",))[0].select("file", "symbol", "variant", "severity")


@q("conditional_chain", f"WITH {fx.FUNCTIONS_SQL} SELECT file, symbol, CASE WHEN ls = 'F' AND rf <> 'A' THEN 'instantiates' ELSE 'ladder' END AS variant, least(100, 45 + chain * 6)::DOUBLE AS severity FROM fn WHERE chain >= 5")
def conditional_chain(spark, d):
    return detect.run_detectors(spark, {"functions": fx.functions(spark, d)}, only=("conditional-chain",))[0].select("file", "symbol", "variant", "severity")


@q("finding_ids", f"WITH {fx.FUNCTIONS_SQL} SELECT 'complexity:' || substr(replace(replace(to_base64(unhex(sha1('complexity  ' || file || '#' || symbol))), '+', '-'), '/', '_'), 1, 16) AS id FROM fn WHERE cognitive >= 15")
def finding_ids(spark, d):
    return detect.run_detectors(spark, {"functions": fx.functions(spark, d)}, only=("complexity",))[0].select("id")


@q("comment_islands", """WITH c AS (SELECT 'u' || user_id % 50 AS file, event_id AS line, event_type = 'click' AS code FROM events WHERE event_type IN ('click', 'view', 'purchase')),
i AS (SELECT *, line - row_number() OVER (PARTITION BY file ORDER BY line) AS island FROM c) SELECT file, min(line)::INTEGER AS start_line, max(line)::INTEGER AS end_line, sum(code::INT)::BIGINT AS code_lines FROM i GROUP BY file, island HAVING sum(code::INT) >= 2""")
def comment_islands(spark, d):
    e = table(spark, d, "events").filter(F.col("event_type").isin("click", "view", "purchase"))
    c = e.select(F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("file"), F.col("event_id").alias("line"), F.when(F.col("event_type") == "click", F.lit("x = 1;")).otherwise(F.lit("plain words")).alias("text"))
    return detect_intra.commented_out_code({"comment_lines": c}, {"lines": 2}).select("file", "start_line", "end_line", F.element_at("measures", "code_lines").cast("long").alias("code_lines"))


@q("score_rank", f"WITH {fx.FINDINGS_SQL} SELECT id, round(score, 9) AS score FROM fs")
def score_rank(spark, d):
    return ranking.score(fx.findings(spark, d)).select("id", F.round("score", 9).alias("score"))


@q("page", f"WITH {fx.FINDINGS_SQL} SELECT id, round(score, 9) AS score FROM fs ORDER BY round(score, 9) DESC, id LIMIT 50 OFFSET 25")
def page(spark, d):
    return ranking.page(ranking.score(fx.findings(spark, d)).withColumn("score", F.round("score", 9)), 25, 50).select("id", "score")


@q("quota_page", f"WITH {fx.FINDINGS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round(score, 9) DESC, id) AS r FROM fs) SELECT id, kind FROM k ORDER BY (r > 5)::INT, round(score, 9) DESC, id LIMIT 40")
def quota_page(spark, d):
    return ranking.quota_page(ranking.score(fx.findings(spark, d)).withColumn("score", F.round("score", 9)), 40, 5).select("id", "kind")


@q("detector_cap", f"WITH {fx.FINDINGS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY detector_id ORDER BY severity DESC, id) AS r FROM f) SELECT id, detector_id FROM k WHERE r <= 20")
def detector_cap(spark, d):
    return ranking.capped(fx.findings(spark, d), 20).select("id", "detector_id")


_GROUPS = """, b AS (SELECT fs.*, count(*) FILTER (declared_key IS NULL) OVER (PARTITION BY file, kind) AS open FROM fs),
k AS (SELECT *, CASE WHEN declared_key IS NOT NULL THEN 'key:' || declared_key WHEN open >= 5 THEN 'file|' || file || '|' || kind ELSE 'one:' || id END AS group_id FROM b),
gr AS (SELECT group_id, min(detector_id) AS detector_id, count(*) AS n, median(quality) AS mq, median(score) AS ms, max(score) AS bs, bool_or(declared_key IS NOT NULL) AS declared, avg(inferred::INT) AS inf FROM k GROUP BY group_id),
gs AS (SELECT *, NOT declared AND n >= 20 AND mq < 0.7 AS degenerate FROM gr), gf AS (SELECT *, CASE WHEN degenerate THEN ms ELSE bs END AS group_score, least(CASE WHEN degenerate THEN 0.5 ELSE 1.0 END, CASE WHEN inf > 0.5 THEN 0.7 ELSE 1.0 END)::DOUBLE AS confidence FROM gs)"""


@q("groups", f"WITH {fx.FINDINGS_SQL}{_GROUPS} SELECT group_id, n, degenerate, confidence, round(group_score, 9) AS group_score FROM gf")
def groups(spark, d):
    return ranking.groups(ranking.group_key(ranking.score(fx.findings(spark, d)))).select("group_id", "n", "degenerate", "confidence", F.round("group_score", 9).alias("group_score"))


@q("group_round_robin", f"WITH {fx.FINDINGS_SQL}{_GROUPS}, r AS (SELECT *, row_number() OVER (PARTITION BY detector_id ORDER BY round(group_score, 9) DESC, group_id) AS round FROM gf) SELECT group_id, round::INTEGER AS round, row_number() OVER (ORDER BY round, round(group_score, 9) DESC, group_id)::INTEGER AS position FROM r")
def group_round_robin(spark, d):
    gr = ranking.groups(ranking.group_key(ranking.score(fx.findings(spark, d)))).withColumn("group_score", F.round("group_score", 9))
    return ranking.round_robin(gr).select("group_id", "round", "position")


@q("merged_rows", f"WITH {fx.FINDINGS_SQL}{_GROUPS} SELECT group_id, count(*) AS member_count, max(severity) AS severity FROM k GROUP BY group_id")
def merged_rows(spark, d):
    return ranking.merge_rows(ranking.group_key(ranking.score(fx.findings(spark, d))).withColumn("hypotheses", F.lit(None).cast("array<string>"))).select("group_id", "member_count", "severity")


@q("normalized_rank", """WITH r AS (SELECT event_id, event_type, rank() OVER (PARTITION BY event_type ORDER BY value) AS lo, count(*) OVER (PARTITION BY event_type, value) AS c, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_id, round(CASE WHEN n > 1 THEN (lo - 1 + (c - 1) / 2.0) / (n - 1) ELSE 0.5 END, 9)::DOUBLE AS r FROM r""")
def normalized_rank(spark, d):
    return stats.percent_rank_of_ties(table(spark, d, "events"), "value", "r", ("event_type",)).select("event_id", F.round("r", 9).alias("r"))


@q("reach_index", g(""", x AS (SELECT id, rank() OVER (ORDER BY fan_out) AS lp, count(*) OVER (PARTITION BY fan_out) AS cp, rank() OVER (ORDER BY fan_in) AS lf, count(*) OVER (PARTITION BY fan_in) AS cf, count(*) OVER () AS n FROM deg)
SELECT id, round(0.5 * (lp - 1 + (cp - 1) / 2.0) / (n - 1) + 0.3 * (lf - 1 + (cf - 1) / 2.0) / (n - 1), 9)::DOUBLE AS reach FROM x"""))
def reach_index(spark, d):
    """The fan-out stands for the rank of a file here."""
    deg = fan_in_out(spark, d).withColumns({"pagerank": F.col("fan_out"), "in_cycle": F.lit(False)})
    return ranking.reach_index(deg).select("id", F.round("reach", 9).alias("reach"))


@q("rule_of_three", "WITH s AS (SELECT event_id, event_type AS kind, user_id % 200 AS pattern FROM events) SELECT event_id FROM (SELECT *, count(*) OVER (PARTITION BY kind, pattern) AS n FROM s) WHERE n >= 3")
def rule_of_three(spark, d):
    s = table(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), (F.col("user_id") % 200).alias("pattern"))
    return ranking.rule_of_three(s).select("event_id")


@q("coverage_rollup", """WITH c AS (SELECT event_type AS detector_id, 'l' || user_id % 3 AS language, (['error', 'presupuesto-agotado', 'no-aplicable', 'sin-grafo', 'sin-aristas', 'sin-metricas', 'corrio'])[1 + event_id % 7] AS status, 1 + event_id % 7 AS r, event_id % 5 AS units, event_id % 2 AS findings FROM events)
SELECT detector_id, language, arg_min(status, r) AS status, sum(units)::BIGINT AS units, sum(findings)::BIGINT AS findings FROM c GROUP BY ALL""")
def coverage_rollup(spark, d):
    e = table(spark, d, "events")
    c = e.select(F.col("event_type").alias("detector_id"), F.concat(F.lit("l"), (F.col("user_id") % 3).cast("string")).alias("language"), F.element_at(F.array(*map(F.lit, ranking.STATUS)), (F.col("event_id") % 7 + 1).cast("int")).alias("status"), (F.col("event_id") % 5).alias("units"), (F.col("event_id") % 2).alias("findings"), F.array().cast("array<string>").alias("missing"))
    return ranking.coverage_rollup(c).drop("missing")


@q("precision_gate", """WITH v AS (SELECT lang, quality FROM labels JOIN documents USING (doc_id)), a AS (SELECT lang, count(*) AS n, sum(quality) AS h FROM v GROUP BY lang)
SELECT lang, n AS judged, h::BIGINT AS true_n, round(h / n, 9)::DOUBLE AS precision,
 round(((h / n) + z * z / (2 * n) - z * sqrt((h / n) * (1 - h / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9)::DOUBLE AS lower, round(((h / n) + z * z / (2 * n) + z * sqrt((h / n) * (1 - h / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9)::DOUBLE AS upper, h / n >= 0.5 AS passes FROM a, (SELECT 1.959963985::DOUBLE AS z)""")
def precision_gate(spark, d):
    v = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select("lang", F.when(F.col("quality") == 1, "verdadero").otherwise("falso").alias("verdict"))
    return quality.precision(v, "lang").select("lang", "judged", "true_n", *(F.round(c, 9).alias(c) for c in ("precision", "lower", "upper")), "passes")


@q("recall_gate", """WITH h AS (SELECT doc_id, md5(text) AS k FROM documents WHERE doc_id % 3 <> 0) SELECT doc_id AS id, CASE WHEN doc_id IN (SELECT doc_id FROM h) THEN 'id' WHEN md5(text) IN (SELECT k FROM h) THEN 'contenido' ELSE 'perdido' END AS status FROM documents""")
def recall_gate(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("content_key"))
    return quality.recall(t, t.filter("id % 3 <> 0")).select("id", "status")


_SNAP = """b AS (SELECT 'u' || user_id % 50 || '|hallazgo:' || event_type AS key, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1), h AS (SELECT 'u' || user_id % 50 || '|hallazgo:' || event_type AS key, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1)"""


def _half(spark, d, rest):
    f = fx.findings(spark, d).withColumn("member_count", F.lit(1))
    return f.filter(F.pmod(F.substring("id", 2, 20).cast("long"), F.lit(2)) == rest)


@q("census", f"WITH {_SNAP} SELECT key, n FROM b")
def census(spark, d):
    return diff.census(_half(spark, d, 0))


@q("census_diff", f"""WITH {_SNAP}, j AS (SELECT coalesce(b.key, h.key) AS key, coalesce(b.n, 0) AS base_n, coalesce(h.n, 0) AS head_n FROM b FULL JOIN h ON b.key = h.key),
c AS (SELECT *, CASE WHEN head_n < base_n THEN CASE WHEN head_n = 0 THEN 'desaparece' ELSE 'baja' END WHEN head_n > base_n THEN 'sube' ELSE 'igual' END AS change FROM j) SELECT *, change = 'baja' AND key LIKE 'u1%click' AS waived FROM c""")
def census_diff(spark, d):
    w = spark.createDataFrame([("u1*click", "baja", 0)], "key string, expected string, min int")
    return diff.census_diff(diff.census(_half(spark, d, 0)), diff.census(_half(spark, d, 1)), w)


@q("snapshot_compare", """WITH f AS (SELECT event_id, event_id % 1000 AS id, md5(coalesce(props, '')) || event_type AS ck, user_id || event_type AS lk, event_id % 2 AS side FROM events),
b0 AS (SELECT * FROM f WHERE side = 0), h0 AS (SELECT event_id, (id + 1) % 1000 AS id, ck, lk FROM f WHERE side = 1),
p1 AS (SELECT x.event_id AS b, y.event_id AS h FROM (SELECT id, min(event_id) AS event_id FROM b0 GROUP BY id HAVING count(*) = 1) x JOIN (SELECT id, min(event_id) AS event_id FROM h0 GROUP BY id HAVING count(*) = 1) y USING (id)),
b1 AS (SELECT * FROM b0 WHERE event_id NOT IN (SELECT b FROM p1)), h1 AS (SELECT * FROM h0 WHERE event_id NOT IN (SELECT h FROM p1)),
p2 AS (SELECT x.event_id AS b, y.event_id AS h FROM (SELECT ck, min(event_id) AS event_id FROM b1 GROUP BY ck HAVING count(*) = 1) x JOIN (SELECT ck, min(event_id) AS event_id FROM h1 GROUP BY ck HAVING count(*) = 1) y USING (ck)),
b2 AS (SELECT * FROM b1 WHERE event_id NOT IN (SELECT b FROM p2)), h2 AS (SELECT * FROM h1 WHERE event_id NOT IN (SELECT h FROM p2)),
p3 AS (SELECT x.event_id AS b, y.event_id AS h FROM (SELECT lk, min(event_id) AS event_id FROM b2 GROUP BY lk HAVING count(*) = 1) x JOIN (SELECT lk, min(event_id) AS event_id FROM h2 GROUP BY lk HAVING count(*) = 1) y USING (lk))
SELECT b AS base_row, h AS head_row, 'id' AS by FROM p1 UNION ALL SELECT b, h, 'content_key' FROM p2 UNION ALL SELECT b, h, 'location_key' FROM p3""")
def snapshot_compare(spark, d):
    e = table(spark, d, "events")
    f = e.select(F.col("event_id").alias("row"), (F.col("event_id") % 1000).alias("id"), F.concat(F.md5(F.coalesce("props", F.lit("")).cast("binary")), "event_type").alias("content_key"), F.concat(F.col("user_id").cast("string"), "event_type").alias("location_key"))
    return diff.pair(f.filter("row % 2 = 0"), f.filter("row % 2 = 1").withColumn("id", (F.col("id") + 1) % 1000))


@q("moved_content", r"""WITH f AS (SELECT doc_id, sha1('text' || chr(10) || n) AS ck, doc_id % 2 AS side FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '/\*.*?\*/', ' ', 'gs'), '(?m)(//|#).*$', ' ', 'g'), '\s+', ' ', 'g')) AS n FROM documents) WHERE n <> ''),
u AS (SELECT ck, side, min(doc_id) AS doc_id FROM f GROUP BY ALL HAVING count(*) = 1)
SELECT b.doc_id AS base_row, h.doc_id AS head_row, 'content_key' AS by FROM u b JOIN u h USING (ck) WHERE b.side = 0 AND h.side = 1""")
def moved_content(spark, d):
    """Two halves of the documents as the findings of two snapshots, each a file of its own: what moved is told by its content."""
    t = table(spark, d, "documents")
    files = t.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    rows = t.select(F.col("doc_id").alias("row"), F.col("doc_id").cast("string").alias("file"), F.col("doc_id").alias("id"), F.lit("text").alias("kind"), F.lit(1).alias("start_line"), F.lit(1 << 30).alias("end_line"))
    found = diff.with_content(rows, files)
    return diff.pair(found.filter("row % 2 = 0"), found.filter("row % 2 = 1"), keys=("id", "content_key"))


@q("partially_introduced", """WITH b AS (SELECT l_orderkey AS o, l_partkey AS p, count(*) AS b FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY ALL), h AS (SELECT l_orderkey AS o, l_partkey AS p, count(*) AS h FROM lineitem GROUP BY ALL)
SELECT o AS row, sum(h - coalesce(b, 0))::BIGINT AS new_places FROM h LEFT JOIN b USING (o, p) WHERE o IN (SELECT o FROM b) AND h > coalesce(b, 0) GROUP BY o""")
def partially_introduced(spark, d):
    """Orders as findings whose places are their parts: carried over from 1997 with places that are new."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("place"), "l_shipdate")
    base = li.filter(F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    one = lambda x: x.select("row", F.col("row").alias("id")).distinct()
    return diff.partially_introduced(diff.pair(one(base), one(li), keys=("id",)), base, li)


@q("edge_diff", g(", b AS (SELECT DISTINCT src, dst, kind FROM raw WHERE roles = 1), h AS (SELECT DISTINCT src, dst, kind FROM raw WHERE roles = 2) (SELECT *, 'added' AS status FROM (SELECT * FROM h EXCEPT SELECT * FROM b)) UNION ALL (SELECT *, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM h))"))
def edge_diff(spark, d):
    e = fx.edges(spark, d)
    return diff.edge_diff(e.filter("roles = 1"), e.filter("roles = 2"))


@q("gc_running_sum", """WITH c AS (SELECT doc_id, n_chars AS bytes, TIMESTAMP '2024-01-15' - INTERVAL 1 HOUR * (doc_id % 400) AS used, source AS v FROM documents), l AS (SELECT * FROM c WHERE v <> 'src0' AND used >= TIMESTAMP '2024-01-15' - INTERVAL 14 DAY),
k AS (SELECT doc_id, row_number() OVER o AS n, sum(bytes) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM l WINDOW o AS (ORDER BY used DESC, doc_id::VARCHAR)) SELECT doc_id FROM k WHERE n <= 600 AND s <= 700000""")
def gc_running_sum(spark, d):
    t = table(spark, d, "documents")
    now = "2024-01-15"
    c = t.select("doc_id", F.lit("r").alias("repo_key"), F.col("doc_id").cast("string").alias("file_path"), F.col("n_chars").alias("bytes"), F.when(F.col("source") == "src0", "old").otherwise("now").alias("analyzer_version"), (F.to_timestamp_ntz(F.lit(now + " 00:00:00")) - F.make_dt_interval(hours=(F.col("doc_id") % 400).cast("int"))).alias("last_used_at"))
    import datetime

    return cache.collect_garbage(c, "now", datetime.datetime(2024, 1, 15), rows=600, most_bytes=700_000).select("doc_id")


@q("incremental_dirty", """WITH old AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey % 10 <> 0), new AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey % 10 = 0 AND l_discount > 0.09) SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 10 <> 0 AND l_partkey IN (SELECT l_partkey FROM new)""")
def incremental_dirty(spark, d):
    li = table(spark, d, "lineitem")
    dirty = li.filter("l_orderkey % 10 = 0 AND l_discount > 0.09").select("l_partkey").distinct()
    return li.filter("l_orderkey % 10 <> 0").join(dirty, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


def _types(spark, d, which: str) -> DataFrame:
    """Suppliers as types, with the brands of their lines as methods."""
    li = table(spark, d, "lineitem").filter(which)
    return li.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("type"), F.col("p_brand").alias("name"), F.lit(0).alias("arity"))


@q("satisfies_division", """WITH m AS (SELECT DISTINCT l_suppkey AS t, p_brand AS sig FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_discount > 0.09 AND l_quantity > 45), n AS (SELECT t, count(*) AS n FROM m GROUP BY t)
SELECT 's' || a.t AS src, 's' || b.t AS dst, CASE WHEN a.n = b.n THEN 'ambiguous' ELSE 'inferred' END AS provenance FROM n a JOIN n b ON a.t <> b.t WHERE b.n >= 2 AND NOT EXISTS (SELECT 1 FROM m x WHERE x.t = b.t AND NOT EXISTS (SELECT 1 FROM m y WHERE y.t = a.t AND y.sig = x.sig))""")
def satisfies_division(spark, d):
    return resolve.satisfies(_types(spark, d, "l_discount > 0.09 AND l_quantity > 45"))


@q("satisfies_division_all")
def satisfies_division_all(spark, d):
    return resolve.satisfies(_types(spark, d, "true"))


_CASCADE = """s AS (SELECT id, dir, folder, name FROM nodes UNION ALL SELECT id, dir, folder, module FROM nodes),
r AS (SELECT l.l_orderkey || '.' || l.l_linenumber AS ref_id, CASE WHEN l.l_linenumber % 2 = 1 THEN t.name ELSE t.module END AS name, o.dir, o.folder FROM lineitem l JOIN nodes t ON t.id = 'part:' || l.l_partkey JOIN nodes o ON o.id = 'part:' || (1 + l.l_suppkey % 100)),
c AS (SELECT ref_id, s.id, CASE WHEN s.dir = r.dir THEN 0 WHEN s.folder = r.folder THEN 2 ELSE 4 END AS d FROM r JOIN s USING (name)),
m AS (SELECT *, count(*) OVER (PARTITION BY ref_id) AS n, min(d) OVER (PARTITION BY ref_id) AS lo FROM c), k AS (SELECT ref_id, max(n) AS n, count(*) FILTER (d = lo) AS nearest FROM m GROUP BY ref_id),
o AS (SELECT CASE WHEN n = 1 THEN 'global-uniqueness' WHEN nearest = 1 THEN 'path-proximity' ELSE 'unresolved' END AS stage, CASE WHEN n = 1 THEN 'resolved' WHEN nearest = 1 THEN 'inferred' ELSE 'ambiguous' END AS outcome FROM k)
SELECT stage, outcome, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9)::DOUBLE AS share FROM o GROUP BY ALL"""


@q("resolution_cascade", g(", " + _CASCADE))
def resolution_cascade(spark, d):
    """Lines refer to their part by name or by type, from the file of another part."""
    p = fx.nodes(spark, d)
    one = lambda c: p.select("id", "file", F.col(c).alias("name"), F.array().cast("array<string>").alias("container"), "family", "exported", "member_of_class_like")
    li = table(spark, d, "lineitem")
    part = lambda n: F.concat(F.lit("part:"), n.cast("string"))
    rows = li.select(F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("ref_id"), "l_linenumber", part(F.col("l_partkey")).alias("id"), part(1 + F.col("l_suppkey") % 100).alias("origin"))
    named = rows.join(p.select("id", "name", "module"), "id").join(p.select(F.col("id").alias("origin"), F.col("file")), "origin")
    refs = named.select("ref_id", "file", F.when(F.col("l_linenumber") % 2 == 1, F.col("name")).otherwise(F.col("module")).alias("name"), F.lit("read").alias("role"), F.array().cast("array<string>").alias("scope"), F.lit(None).cast("string").alias("qualifier"), *(F.lit(False).alias(c) for c in ("qualifier_is_bare_constant", "shadowed_locally", "is_callee", "in_type_slot")))
    f = resolve.funnel(resolve.decide(resolve.contexts(refs), one("name").unionByName(one("module"))))
    return f.select("stage", "outcome", "n", F.round("share", 9).alias("share"))


@q("incremental_graph", g(""", rf AS (SELECT DISTINCT l.l_orderkey || '.' || l.l_linenumber || '.' || l.l_partkey || '.' || l.l_suppkey AS ref_id, t.name AS name, o.id AS src, o.dir, o.folder FROM lineitem l JOIN nodes t ON t.id = 'part:' || l.l_partkey JOIN nodes o ON o.id = 'part:' || (1 + l.l_suppkey % 100)),
c AS (SELECT ref_id, src, s.id, CASE WHEN s.dir = r.dir THEN 0 WHEN s.folder = r.folder THEN 2 ELSE 4 END AS d FROM rf r JOIN nodes s USING (name)),
m AS (SELECT *, count(*) OVER (PARTITION BY ref_id) AS n, min(d) OVER (PARTITION BY ref_id) AS lo FROM c),
k AS (SELECT ref_id, src, max(n) AS n, count(*) FILTER (d = lo) AS nearest, min(id) AS least, min(id) FILTER (d = lo) AS near FROM m GROUP BY ALL),
e AS (SELECT src, CASE WHEN n > 1 AND nearest = 1 THEN near ELSE least END AS dst, CASE WHEN n = 1 THEN 2 WHEN nearest = 1 THEN 1 ELSE 0 END AS s FROM k),
b AS (SELECT *, max(s) OVER (PARTITION BY src, dst) AS top FROM e)
SELECT src, dst, 'references' AS kind, CASE top WHEN 2 THEN 'resolved' WHEN 1 THEN 'inferred' ELSE 'ambiguous' END AS provenance, count(*) AS weight FROM b WHERE s = top GROUP BY ALL"""))
def incremental_graph(spark, d):
    """Lines refer to parts by name. The graph is built without the lines since 1996, with small parts under an old name and without the large ones, and then brought up to date."""
    p = fx.nodes(spark, d).join(table(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), "p_size"), "id").withColumn("container", F.array().cast("array<string>"))
    small, large = p.filter("p_size <= 5"), p.filter("p_size >= 45")
    former = small.withColumn("name", F.concat(F.lit("old "), "name"))
    part = lambda n: F.concat(F.lit("part:"), n.cast("string"))
    li = table(spark, d, "lineitem").select(F.concat_ws(".", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("ref_id"), part(F.col("l_partkey")).alias("id"), part(1 + F.col("l_suppkey") % 100).alias("from_id"), "l_shipdate")
    refs = li.join(p.select("id", "name"), "id").join(p.select(F.col("id").alias("from_id"), "file"), "from_id").withColumns({"role": F.lit("read"), "scope": F.array().cast("array<string>"), "qualifier": F.lit(None).cast("string")} | {c: F.lit(False) for c in ("qualifier_is_bare_constant", "shadowed_locally", "is_callee", "in_type_slot")})
    late = F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")
    wrong = refs.filter(~late).withColumns({"ref_id": F.concat(F.lit("x"), "ref_id"), "name": F.concat(F.lit("old "), "name")})
    kept = incremental_graph_module.Graph(spark, f"{checkpoint_dir(spark)}/graph-{uuid.uuid4().hex}")
    kept.build(p.filter("p_size BETWEEN 6 AND 44").unionByName(former), refs.filter(~late).unionByName(wrong).dropDuplicates(["ref_id"]))
    kept.update(former, small.unionByName(large), wrong, refs.filter(late))
    return kept.edges()


@q("propagated_types", """WITH RECURSIVE li AS (SELECT l_orderkey || '.' || l_linenumber AS site, l_orderkey || '.' || (l_linenumber + 1) AS after, * FROM lineitem JOIN part ON p_partkey = l_partkey),
o AS (SELECT DISTINCT site, p_brand AS type, CASE WHEN l_discount < 0.01 THEN 3 WHEN l_discount < 0.06 THEN 2 ELSE 0 END AS s FROM li WHERE l_returnflag = 'R'),
f AS (SELECT site AS src, after AS dst FROM li UNION SELECT after, site FROM li WHERE l_linestatus = 'F'), a AS (SELECT * FROM f WHERE dst NOT IN (SELECT site FROM o WHERE s = 3)),
t(site, type, s) AS (SELECT * FROM o UNION SELECT dst, type, least(s, 1) FROM t JOIN a ON src = site),
k AS (SELECT site, type, max(s) AS s FROM t GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY site) > 3 AS many FROM k)
SELECT DISTINCT site, CASE WHEN many THEN '*' ELSE type END AS type, CASE WHEN many OR s = 0 THEN 'ambiguous' WHEN s = 1 THEN 'inferred' WHEN s = 2 THEN 'resolved' ELSE 'declared' END AS provenance FROM n""")
def propagated_types(spark, d):
    """Lines are sites: returned ones hold their part's brand, and values flow along an order, in finished ones back as well."""
    # Parts grow with the lines: not a table to broadcast.
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand").hint("merge"), "l_partkey")
    at = lambda n: F.concat_ws(".", F.col("l_orderkey").cast("string"), n.cast("string"))
    li = li.withColumns({"site": at(F.col("l_linenumber")), "after": at(F.col("l_linenumber") + 1)})
    known = F.when(F.col("l_discount") < 0.01, "declared").when(F.col("l_discount") < 0.06, "resolved").otherwise("ambiguous")
    arc = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    on, back = arc("site", "after"), arc("after", "site")
    flows = li.select(F.inline(F.when(F.col("l_linestatus") == "F", F.array(on, back)).otherwise(F.array(on))))
    return flow.propagate(li.filter("l_returnflag = 'R'").select("site", F.col("p_brand").alias("type"), known.alias("provenance")), flows, most=3)


@q("java_functions", """WITH m AS (SELECT 'o' || l_orderkey || '.java' AS file, 'f' || l_linenumber AS name, (l_suppkey % 8)::INTEGER AS parameters, (l_linenumber % 4)::INTEGER AS deep, (l_partkey % 7)::INTEGER AS arms, l_returnflag = 'R' AS made FROM lineitem)
SELECT file, name, parameters, deep + arms AS branches, greatest(arms, CASE WHEN deep > 0 THEN 1 ELSE 0 END)::INTEGER AS chain, (deep * (deep + 1) // 2 + arms)::INTEGER AS cognitive, greatest(deep, CASE WHEN arms > 0 THEN 1 ELSE 0 END)::INTEGER AS max_nesting,
  (4 + 2 * deep + CASE WHEN arms > 0 THEN 2 * arms + 1 ELSE 0 END)::INTEGER AS lines, made AS chain_instantiates FROM m""")
def java_functions(spark, d):
    """Every order as a Java class, a method to a line: facts of the text against the numbers that it was written from."""
    n = {"parameters": F.col("l_suppkey") % 8, "deep": F.col("l_linenumber") % 4, "arms": F.col("l_partkey") % 7}
    li = table(spark, d, "lineitem").withColumns({k: v.cast("int") for k, v in n.items()})
    each = lambda k, f: F.array_join(F.when(F.col(k) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.col(k), F.lit(1))), f)).otherwise(F.array().cast("array<string>")), "")
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    params = F.regexp_replace(each("parameters", lambda i: text(", int p", i)), "^, ", "")
    arms = F.regexp_replace(each("arms", lambda i: text(" else if (q == ", i, ") {\n return ", i, ";\n}")), "^ else ", "")
    made = F.when(F.col("l_returnflag") == "R", "x(new Y(p)); // if (z) {\n").otherwise('x("{ if");\n')
    method = text("int f", F.col("l_linenumber"), "(", params, ") {\n", each("deep", lambda i: text("if (p > ", i, ") {\n")), made, each("deep", lambda i: F.lit("}\n")), F.when(F.col("arms") > 0, text(arms, "\n")).otherwise(""), "return 0;\n}\n")
    files = li.withColumn("m", method).groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("m")), "\n").alias("m"))  # the lines of one order
    files = files.select(text("o", F.col("l_orderkey"), ".java").alias("path"), text("/* { */ class O", F.col("l_orderkey"), " {\n", F.col("m"), "}\n").alias("content"))
    f = braces.functions(braces.Sources(files))
    return f.select("file", "name", "parameters", F.col("branches").cast("int").alias("branches"), F.col("chain").cast("int").alias("chain"), F.col("cognitive").cast("int").alias("cognitive"), F.col("max_nesting").cast("int").alias("max_nesting"), (F.col("end_line") - F.col("start_line") + 1).alias("lines"), "chain_instantiates")


@q("find_similar_tfidf", """WITH t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents), c AS (SELECT id, term, count(*) AS c FROM t GROUP BY ALL), n AS (SELECT count(DISTINCT id) AS n FROM c), df AS (SELECT term, count(*) AS df FROM c GROUP BY term),
w0 AS (SELECT id, term, (1 + ln(c)) * (ln((n + 1) / (df + 1)) + 1) AS w FROM c JOIN df USING (term), n), no AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w0 GROUP BY id), w AS (SELECT id, term, w / norm AS w FROM w0 JOIN no USING (id))
SELECT a.id, round(sum(a.w * b.w), 6) AS score FROM w a JOIN w b USING (term) WHERE b.id = 1 AND a.id <> 1 GROUP BY a.id HAVING sum(a.w * b.w) >= 0.15 ORDER BY sum(a.w * b.w) DESC, a.id LIMIT 20""")
def find_similar_tfidf(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("c"))
    return navigate.find_similar(t, 1).select("id", F.round("score", 6).alias("score"))


@q("impact_bfs", g(""", up AS (SELECT DISTINCT dst AS id, src AS o FROM merged WHERE weight >= 49), r(id, depth) AS (SELECT 'part:1', 0 UNION SELECT o, depth + 1 FROM r JOIN up USING (id) WHERE depth < 3) SELECT id, min(depth) AS depth FROM r GROUP BY id"""))
def impact_bfs(spark, d):
    e = fx.facts(spark, d)["edges"].filter("weight >= 49")
    return navigate.upward(e, spark.createDataFrame([("part:1",)], "id string"), 3)


@q("impact_bfs_all")
def impact_bfs_all(spark, d):
    return navigate.upward(fx.facts(spark, d, merged=False)["edges"], spark.createDataFrame([("part:1",)], "id string"), 3)


@q("path_shortest", g(""", s AS (SELECT DISTINCT src AS a, dst AS b FROM merged WHERE weight >= 40 UNION SELECT dst, src FROM merged WHERE weight >= 40), r(id, c) AS (SELECT 'part:1', 0 UNION SELECT b, c + 1 FROM r JOIN s ON s.a = r.id WHERE c < 6) SELECT min(c) AS cost FROM r WHERE id = 'part:100' HAVING min(c) IS NOT NULL"""))
def path_shortest(spark, d):
    e = fx.facts(spark, d)["edges"].filter("weight >= 40")
    return navigate.shortest_path(e, "part:1", "part:100", most=6).select("cost")


@q("path_shortest_all")
def path_shortest_all(spark, d):
    """Over all edges, at the production number of hops."""
    return navigate.shortest_path(fx.facts(spark, d, merged=False)["edges"], "part:1", "part:100").select("cost")


@q("risky_files", g(""", f AS (SELECT file, sum(p_size)::DOUBLE AS severity, count(*) AS problems FROM nodes GROUP BY file), u AS (SELECT dst AS file, count(DISTINCT src) AS users FROM fe GROUP BY dst)
SELECT file, severity, problems, coalesce(users, 0)::BIGINT AS users, severity * (1 + coalesce(users, 0)) AS risk FROM f LEFT JOIN u USING (file)"""))
def risky_files(spark, d):
    f = fx.facts(spark, d, merged=False)
    p = graph.project(f["nodes"], f["edges"], "file").select(F.col("dst").alias("file"), F.col("src").alias("user"))
    return navigate.risky_files(f["nodes"].select("file", F.col("end_line").cast("double").alias("severity")), p)


@q("symbol_neighbors", g("SELECT 'out' AS direction, dst AS id, kind, provenance, weight FROM merged WHERE src = 'part:7' UNION ALL SELECT 'in', src, kind, provenance, weight FROM merged WHERE dst = 'part:7'"))
def symbol_neighbors(spark, d):
    return navigate.neighbors(fx.facts(spark, d)["edges"], "part:7")


@q("find_symbol", "SELECT 'part:' || p_partkey AS id, p_name AS name FROM part WHERE lower(p_name) LIKE '%1%'")
def find_symbol(spark, d):
    return navigate.find_symbol(fx.nodes(spark, d), "1").select("id", "name")


@q("repo_summary", f"WITH {fx.FINDINGS_SQL} SELECT kind, count(*) AS n, max(severity) AS worst FROM f GROUP BY kind")
def repo_summary(spark, d):
    return navigate.repo_summary(fx.findings(spark, d)).drop("worst_file")


@q("benchmark_percentiles", """WITH s AS (SELECT event_type AS metric, 'l' || user_id % 3 AS language, round(value) AS value FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY metric, language ORDER BY value) AS k, count(*) OVER (PARTITION BY metric, language) AS n FROM s)
SELECT metric, language, max(n) AS n, min(value) FILTER (k >= ceil(n * 0.5)) AS p50, min(value) FILTER (k >= ceil(n * 0.9)) AS p90, min(value) FILTER (k >= ceil(n * 0.95)) AS p95, min(value) FILTER (k >= ceil(n * 0.99)) AS p99 FROM r GROUP BY ALL""")
def benchmark_percentiles(spark, d):
    return quality.benchmark(table(spark, d, "events").select(F.col("event_type").alias("metric"), F.concat(F.lit("l"), (F.col("user_id") % 3).cast("string")).alias("language"), F.round("value").alias("value")))


@q("import_suffix_join", """WITH n AS (SELECT p_partkey, p_brand || '/' || replace(p_type, ' ', '_') || '/p' || p_partkey || '.py' AS path FROM part) SELECT 'main' AS file, 'p' || p_partkey AS specifier, path AS target FROM n""")
def import_suffix_join(spark, d):
    p = fx.nodes(spark, d).select(F.regexp_replace("file", r"\.src$", ".py").alias("path"))
    i = p.select(F.lit("main").alias("file"), F.regexp_extract("path", r"([^/]+)\.py$", 1).alias("specifier"))
    return resolve.import_targets(i, p)
