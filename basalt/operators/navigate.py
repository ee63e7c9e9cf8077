"""Navigation queries: neighbours, paths, impact, hierarchy, similarity, tests, risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import cut
from ..functions.text import identifier_words

#: Costs and bounds of the searches.
CONTAINS_COST, PATH_HOPS, IMPACT_DEPTH, HIERARCHY_DEPTH, SIMILAR, NAME_WEIGHT = 3, 12, 3, 6, 0.15, 3
#: Digits of a similarity that order results.
SCORE_DIGITS = 12
HIERARCHY = ("extends", "implements", "mixes-in", "satisfies")


def find_symbol(nodes: DataFrame, text: str) -> DataFrame:
    return nodes.filter(F.lower("name").contains(text.lower())).orderBy("name", "id")


def resolve_node(nodes: DataFrame, text: str) -> DataFrame:
    """The node of this id or file, else the one whose name it is; candidates with unique = false otherwise."""
    hit = nodes.withColumn("rank", F.when(F.col("id") == text, 0).when((F.col("kind") == "file") & (F.col("file") == text), 1).when(F.lower("name") == text.lower(), 2)).filter("rank IS NOT NULL")
    best = hit.withColumn("_b", F.min("rank").over(Window.partitionBy(F.lit(0)))).filter("rank = _b").drop("_b")
    return best.withColumn("unique", F.count("*").over(Window.partitionBy(F.lit(0))) == 1)


def neighbors(edges: DataFrame, id: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    e = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
    return e.filter(F.col("src") == id).select(F.lit("out").alias("direction"), F.col("dst").alias("id"), "kind", "provenance", "weight").unionByName(e.filter(F.col("dst") == id).select(F.lit("in").alias("direction"), F.col("src").alias("id"), "kind", "provenance", "weight"))


def ego(edges: DataFrame, id: str, hops: int = 1) -> DataFrame:
    """Edges within ``hops`` of a node."""
    ids = edges.sparkSession.createDataFrame([(id,)], "id string")
    for _ in range(hops):
        step = edges.select(F.col("src").alias("id"), F.col("dst").alias("o")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("o")))
        ids = ids.unionByName(step.join(ids, "id").select(F.col("o").alias("id"))).distinct()
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def shortest_path(edges: DataFrame, source: str, target: str, directed: bool = False, most: int = PATH_HOPS) -> DataFrame:
    """cost, path of the cheapest walk of at most ``most`` hops; ``contains`` costs 3, other edges 1. Best cost per node and round, ties to the least path."""
    cost = F.when(F.col("kind") == "contains", CONTAINS_COST).otherwise(1)
    step = edges.select(F.col("src").alias("id"), F.col("dst").alias("to"), cost.alias("c"))
    if not directed:
        step = step.unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("to"), cost.alias("c")))
    step = cut(step.groupBy("id", "to").agg(F.min("c").alias("c")))
    best = edges.sparkSession.createDataFrame([(source, 0, [source])], "id string, cost int, path array<string>")
    front = best
    for _ in range(min(most, 30)):
        new = front.join(step, "id").select(F.col("to").alias("id"), (F.col("cost") + F.col("c")).alias("cost"), F.concat("path", F.array("to")).alias("path"))
        both = best.unionByName(new).groupBy("id").agg(F.min(F.struct("cost", "path")).alias("b")).select("id", "b.cost", "b.path")
        both = cut(both)
        front = both.join(best.select("id", F.col("cost").alias("_o")), "id", "left").filter("_o IS NULL OR cost < _o").drop("_o")
        best = both
        if front.isEmpty():
            break
    return best.filter(F.col("id") == target).select("cost", "path")


def upward(edges: DataFrame, seeds: DataFrame, depth: int = IMPACT_DEPTH) -> DataFrame:
    """id, depth: what depends on the seeds (id), against the edges other than ``contains``, and the owners of what is reached."""
    up = edges.filter("kind NOT IN ('contains', 'affects')").select(F.col("dst").alias("id"), F.col("src").alias("o"))
    owner = edges.filter("kind = 'contains'").select(F.col("dst").alias("id"), F.col("src").alias("o")).filter(F.col("o").startswith("sym:"))
    step = up.unionByName(owner).distinct()
    seen = seeds.select("id", F.lit(0).alias("depth")).distinct()
    front = seen
    for d in range(1, min(depth, 8) + 1):
        front = cut(front.join(step, "id").select(F.col("o").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def changed_symbols(symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """Symbols whose lines meet changed ranges (file, from_line, to_line)."""
    j = symbols.join(ranges.select("file", "from_line", "to_line"), "file").filter("start_line <= to_line AND end_line >= from_line")
    return j.select(*symbols.columns).distinct()


def implementations(edges: DataFrame, id: str, depth: int = HIERARCHY_DEPTH) -> DataFrame:
    down = edges.filter(F.col("kind").isin(*HIERARCHY)).withColumn("kind", F.lit("references"))
    return upward(down, edges.sparkSession.createDataFrame([(id,)], "id string"), min(depth, 10)).filter("depth > 0")


def file_overview(nodes: DataFrame, edges: DataFrame, findings: DataFrame, file: str) -> DataFrame:
    """section, item of one file: its symbols, imports, importers and problems."""
    ends = edges.filter("kind = 'imports'")
    parts = [
        nodes.filter((F.col("file") == file) & (F.col("kind") == "symbol")).select(F.lit("symbol").alias("section"), F.col("name").alias("item")),
        ends.filter(F.col("src") == f"file:{file}").select(F.lit("imports").alias("section"), F.col("dst").alias("item")),
        ends.filter(F.col("dst") == f"file:{file}").select(F.lit("importer").alias("section"), F.col("src").alias("item")),
        findings.filter(F.col("file") == file).select(F.lit("problem").alias("section"), F.col("id").alias("item")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tfidf(terms: DataFrame) -> DataFrame:
    """id, term, w: (1 + ln tf) * (ln((n + 1) / (df + 1)) + 1), scaled to length one. terms: id, term, c."""
    n = terms.select("id").distinct().agg(F.count("*").alias("n"))
    df = terms.groupBy("term").agg(F.count_distinct("id").alias("df"))
    w = terms.join(df, "term").join(F.broadcast(n), F.lit(True)).select("id", "term", ((1 + F.log("c")) * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)).alias("w"))
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


def find_similar(terms: DataFrame, probe: str | int, k: int = 20, least: float = SIMILAR) -> DataFrame:
    """id, score of the k entries most like the probe by cosine: only the probe's few terms go into the join.

    Sums that differ by the order of their addends alone, as those of copies do, are one score: the id decides.
    """
    w = tfidf(terms)
    p = w.filter(F.col("id") == probe).select("term", F.col("w").alias("_w"))
    return w.filter(F.col("id") != probe).join(p, "term").groupBy("id").agg(F.sum(F.col("w") * F.col("_w")).alias("score")).filter(F.col("score") >= least).orderBy(F.round("score", SCORE_DIGITS).desc(), "id").limit(k)


def symbol_terms(nodes: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Terms of symbols: words of the name three times, of neighbours' names once."""
    own = nodes.select("id", F.explode(identifier_words(F.col("name"))).alias("term"), F.lit(NAME_WEIGHT).alias("c"))
    near = neighbours.select("id", F.explode(identifier_words(F.col("name"))).alias("term"), F.lit(1).alias("c"))
    return own.unionByName(near).groupBy("id", "term").agg(F.sum("c").alias("c"))


def tests_for(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """Test files that mention names of five characters and more; of six hits or more, names in over a third of them say nothing."""
    n = names.filter(F.length("name") >= 5).select("name").distinct()
    hit = mentions.join(n, "name", "left_semi").select("file", "name").distinct()
    total = hit.select("file").distinct().agg(F.count("*").alias("t"))
    common = hit.groupBy("name").agg(F.count("*").alias("c")).join(F.broadcast(total), F.lit(True)).filter((F.col("t") >= 6) & (F.col("c") > F.col("t") / 3)).select("name")
    return hit.join(common, "name", "left_anti").groupBy("file").agg(F.count("*").alias("names"))


def risky_files(findings: DataFrame, users: DataFrame) -> DataFrame:
    """file, risk = severities * (1 + distinct user files). users: file, user."""
    s = findings.groupBy("file").agg(F.sum("severity").alias("severity"), F.count("*").alias("problems"))
    u = users.filter("file <> user").groupBy("file").agg(F.count_distinct("user").alias("users"))
    return s.join(u, "file", "left").select("file", "severity", "problems", F.coalesce("users", F.lit(0)).cast("long").alias("users"), (F.col("severity") * (1 + F.coalesce("users", F.lit(0)))).alias("risk"))


def list_problems(findings: DataFrame, file: str | None = None, kind: str | None = None, layer: str | None = None, recommended: bool = False) -> DataFrame:
    f = findings
    if file:
        f = f.filter(F.col("file").contains(file))
    if kind:
        f = f.filter(F.col("kind") == kind)
    if layer:
        f = f.filter(F.exists("hypotheses", lambda h: h["layer"] == layer))
    if recommended:
        f = f.filter(F.size("hypotheses") > 0)
    return f.orderBy(F.col("severity").desc(), "id")


def repo_summary(findings: DataFrame) -> DataFrame:
    """kind, n, worst severity and where."""
    return findings.groupBy("kind").agg(F.count("*").alias("n"), F.max("severity").alias("worst"), F.min_by("file", F.struct(-F.col("severity"), F.col("id"))).alias("worst_file"))
