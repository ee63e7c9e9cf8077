from collections import Counter

import corpus_pipeline as c
from basalt.llm import toxicity

from . import brute

SF = "/root/testdata/sf0.001"


def test_every_stage_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.collect()]
    for name, stage in c.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.collect())
    start, calm, single, cleaned, mixed, packed = seen
    score = {r.doc_id: r.score for r in toxicity.classify(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r.doc_id for r in calm} == {r.doc_id for r in start if score[r.doc_id] < 0.7}
    group = brute.jaccard([(r.doc_id, r.text) for r in calm], 5, 4, 5)
    assert {r.doc_id for r in single} == {i for i, (_, g) in group.items() if g == i}
    want = brute.suffixes([(r.doc_id, r.text) for r in single])
    assert {r.doc_id: r.text for r in cleaned} == {i: v[3].decode("utf-8", "ignore") for i, v in want.items()}
    assert all(r.n_chars == len(r.text) for r in cleaned)
    copies = Counter(r.doc_id for r in mixed)
    text = {r.doc_id: r.text for r in cleaned}
    assert set(copies) <= set(text) and max(copies.values()) <= 2 and all(r.text == text[r.doc_id] for r in mixed)
    size = {i: len(brute.words(t)) for i, t in text.items()}
    assert abs(sum(size[i] * n for i, n in copies.items()) - 1.5 * sum(size.values())) < 0.02 * sum(size.values())
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies
    assert all(list(r.asDict()) == list(c.COLUMNS) for rows in seen[:-1] for r in rows[:1])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, spans binary, key long, bucket int, piece int, size long, copies long"


def odd(spark, n=40):
    """Nulls, empty and long texts, equal rows, ids with two texts and null ids, beside columns whose names the stages use."""
    base = [(i, " ".join(f"w{i}x{j}" for j in range(30 + i)), "en", "ab"[i % 2]) for i in range(n)]
    base += [(1, base[1][1], "en", "b"), (2, "another text of the same id " * 3, "de", None), (None, None, None, None), (None, "a text without an id " * 20, None, None), (None, "a text without an id " * 20, None, None), (90, "", "fr", "a"), (91, " ".join(f"long{j}" for j in range(60_000)), "en", "c")]
    return spark.createDataFrame([(*r, 1, 0.5, 1, b"x", 7, 3, 2, 9, 4) for r in base], SCHEMA).repartition(3), base


def test_stages_on_odd_rows(spark):
    docs, base = odd(spark)
    for name, stage in c.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    show = lambda df: Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    rows = Counter((i, t) for i, t, _, _ in base)
    calm = dict(c.STAGES)["toxicity"](spark, docs, SF)
    assert calm.columns == list(c.COLUMNS) and show(calm) <= rows and sum(show(calm).values()) >= len(base) - 4
    single = show(dict(c.STAGES)["ngram_jaccard_join"](spark, docs, SF))
    assert single == rows  # no two ids are alike; equal ids are one document
    cleaned = dict(c.STAGES)["suffix_array_dedup"](spark, docs, SF)
    text = Counter((r.doc_id, r.text) for r in cleaned.collect())
    assert sum(text.values()) == len(base) and (91, base[-1][1]) in text and text[2, "another text of the same id " * 3] == 1 and text[None, ""] == 3
    mixed = show(dict(c.STAGES)["source_mixing"](spark, docs, SF))
    assert all(n <= 2 * rows[k] for k, n in mixed.items())
    words = lambda counter: sum(n * len(brute.words(t)) for (_, t), n in counter.items())
    assert words(mixed) <= 2 * words(rows)
    packed = dict(c.STAGES)["best_fit_packing"](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(i for i, *_ in base)


def test_mixing_stage_takes_rows_that_share_an_id(spark):
    rows = [(None if i % 3 == 0 else 7, f"text {i % 50} " * (3 + i % 11), "en", "ab"[i % 2], 1) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    taken, size = Counter(), Counter()
    for r in c.mix_sources(spark, docs, SF).collect():
        taken[r.source] += len(brute.words(r.text))
    for r in rows:
        size[r[3]] += len(brute.words(r[1]))
    total = 1.5 * sum(size.values())
    a = min(2 * size["a"], max(total * 3 / 4, total - 2 * size["b"]))
    assert abs(taken["a"] - a) <= 30 and abs(taken["b"] - (total - a)) <= 30
