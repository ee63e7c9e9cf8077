"""Java sources from text to findings."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from basalt.operators import braces, detect, detect_inter, detect_intra, extract  # noqa: F401
from basalt.plans import analyze

SHOP = Path(__file__).with_name("fixtures_java.txt").read_text()


def sources():
    """path -> text; files of the fixture are parted by lines of ``=== path``."""
    out = {}
    for part in SHOP.split("=== ")[1:]:
        path, text = part.split("\n", 1)
        out[path] = text
    return out


@pytest.fixture(scope="module")
def java(spark):
    files = spark.createDataFrame(list(sources().items()), "path string, content string").repartition(2)
    s = braces.Sources(files)
    return s, s.facts()


def test_blocks_and_functions(java):
    s, facts = java
    rows = {(r.name, r.class_name): r for r in facts["functions"].filter("file = 'shop/Shop.java'").collect()}
    run, make = rows[("run", "Shop")], rows[("make", "Shop")]
    assert (run.branches, run.chain, run.cognitive, run.max_nesting, run.parameters, run.start_line, run.end_line) == (8, 3, 13, 3, 6, 24, 57)
    assert make.chain_instantiates and make.is_factory_like and make.chain == 3 and rows[("Shop", "Shop")].is_constructor
    assert ("visit", None) in rows and rows[("deep", "Inner")].fn_id == "shop/Shop.java#Shop.Inner.deep@95"
    kinds = {r.kind for r in s.blocks.collect()}
    assert {"type", "method", "if", "else if", "else", "for", "while", "try", "catch", "switch", "lambda", "anonymous", "array"} <= kinds
    assert all(r.close is not None and r.close > r.open for r in s.blocks.collect())


def test_fact_tables(java):
    _, facts = java
    shop = lambda k, *cols: {tuple(r[c] for c in cols) for r in facts[k].collect() if r["file"] == "shop/Shop.java"}
    assert shop("imports", "specifier") == {("shop/model/Order",), ("java/util/List/of",)}
    assert shop("supertypes", "type", "base", "form") == {("Shop", "Base", "extends"), ("Shop", "Runnable", "implements"), ("Shop", "Closing", "implements")}
    assert ("run", None, 6) in shop("references", "name", "qualifier", "arg_count") and ("info", "log", 1) in shop("references", "name", "qualifier", "arg_count")
    assert ("size", 2, "method") in shop("members", "name", "arity", "kind") and ("getLast", 0, "accessor") in shop("members", "name", "arity", "kind") and ("byName", None, "field") in shop("members", "name", "arity", "kind")
    assert {t for _, t in shop("comment_lines", "line", "text")} == {"total = price * count;", "if (total > 0) { return total; }", "plain note"}
    for kind, df in facts.items():
        if kind in extract.SCHEMAS:
            assert [c.split()[0] for c in extract.SCHEMAS[kind].split(", ")] == df.columns, kind
    assert "visit" not in {c for r in facts["call_sequences"].collect() for c in r.calls}


#: Detector and where it finds something in the fixture: all within functions and files, then those that read what only Java sources give.
FOUND = {
    "complexity": "tangled", "long-function": "lengthy", "long-parameter-list": "run", "conditional-chain": "dispatch", "many-returns": "run", "boolean-complexity": "run", "boolean-flag-param": "run",
    "argument-mutation": "run", "empty-catch": "run", "flag-accumulator": "run", "type-switch": "make", "unreachable-code": "run", "demeter-chain": "run", "unused-variable": "run",
    "commented-out-code": None, "data-clump": None, "primitive-obsession": "run", "data-class": "Point", "repeated-switch": None, "inheritance-family": "Visitor", "self-referential-member": "Node",
    "refused-bequest": "Quiet", "temporary-field": "Draft", "lazy-init-repetida": "Shop", "manual-notification": "Panel", "hard-wired-notification": "Panel", "optional-behavior-flags": "Panel",
    "enumerated-field-dispatch": "Door", "exclusive-dispatch-ladder": "dispatch", "exposed-container-traversal": "Basket", "homonymous-delegation": "Panel", "homonymous-divergent-sequence": "Visitor",
    "repeated-access-control": "Vault", "repeated-configured-assembly": "Widget", "recursive-collection-descent": "Node", "feature-envy-intra": "envy",
    "hardwired-subtype-combination": "Button", "optional-construction-combinations": "Order", "repeated-absence-check": "Vault",
}


def test_every_detector_fires_from_source(spark, java):
    _, facts = java
    found, coverage = detect.run_detectors(spark, facts, only=tuple(FOUND), extra=True)
    assert {r.detector_id: r.status for r in coverage.collect()} == dict.fromkeys(FOUND, "corrio")
    got = {}
    for r in found.collect():
        got.setdefault(r.detector_id, set()).add(r.symbol)
    assert {d: s for d, s in FOUND.items() if s not in got.get(d, set())} == {}
    clean = {r.symbol for r in found.filter(F.col("file") == "shop/Clean.java").collect()}
    assert clean == set()


def test_java_edges_and_analysis(spark):
    few = {p: t for p, t in sources().items() if p in ("shop/Shop.java", "shop/model/Order.java", "shop/Visitor.java")}
    files = spark.createDataFrame([*few.items(), ("m.py", "def f():\n    return 1\n")], "path string, content string")
    kept = files.withColumn("language", F.when(F.col("path").endswith(".py"), "python").otherwise("java"))
    out = analyze.build_graph(extract.facts_of_files(kept), kept)
    edges = {(r.src.split("#")[-1], r.dst.split("#")[-1], r.kind, r.provenance) for r in out["edges"].collect()}
    assert ("file:shop/Shop.java", "file:shop/model/Order.java", "imports", "declared") in edges
    assert ("Shop", "Closing", "implements", "declared") in edges and ("Loud", "Visitor", "extends", "declared") in edges
    assert ("Shop.make", "Shop.run", "calls", "resolved") in edges and ("Shop.make", "Order", "instantiates", "resolved") in edges
    assert ("Shop", "Order", "declares-type", "declared") in edges
    assert {r.language for r in out["functions"].select("language").distinct().collect()} == {"java", "python"}
