import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from basalt.llm import jaccard_join, substring_dedup, suffix_dedup, textnp

from . import brute

SCHEMA = "doc_id long, text string, range int, ids string, component string"


def corpus(seed=5):
    r = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    base = [" ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 3, 8, 40, 120, 300]))) for _ in range(40)]
    passage = " ".join(r.choice(vocab) for _ in range(70))
    out = list(base) + base[:6] + base[10:12] * 3
    big = " ".join(r.choice(vocab) for _ in range(200)).split()
    for n in range(40):  # a crowd of near copies
        w = list(big)
        for _ in range(n % 6):
            w[r.randrange(len(w))] = f"x{r.random()}"
        out.append(" ".join(w))
    for n in range(8):
        out.append(f"{base[n][:80]} {passage}\n {base[-n][:60]}")
    out += [None, "", "A b C d", "a B c d", "a b c", "solo", passage + " " + passage, "ab " * 300, " ".join(big) + " tail" * 3]
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in corpus()], SCHEMA).repartition(3)


@pytest.mark.parametrize("k,t", [(4, Fraction(85, 100)), (5, Fraction(4, 5)), (2, Fraction(1, 2))])
def test_jaccard_links(docs, k, t):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs, k, t).collect()}
    assert got == brute.jaccard(corpus(), k, t.numerator, t.denominator)


def test_jaccard_small_crowds_and_blocks(docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FEW", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 600)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs).collect()}
    assert got == brute.jaccard(corpus())


def brute_links(rows, k=4, t=Fraction(85, 100)):
    sets = {}
    for i, text in rows:
        w = brute.words((text or "").translate(brute.LOW))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    return {i: sum(1 for j, y in sets.items() if i != j and x and y and len(x & y) >= t * len(x | y)) for i, x in sets.items()}


@pytest.mark.parametrize("few,block", [(12, 400_000), (2, 600), (50, 600), (4, 400_000)])
def test_jaccard_counts_every_link(docs, monkeypatch, few, block):
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    assert {r.doc_id: r.n_links for r in jaccard_join.links(docs).collect()} == brute_links(corpus())


def test_jaccard_blocks_are_bounded_by_sets(docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FEW", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 8)
    assert {r.doc_id: r.n_links for r in jaccard_join.links(docs).collect()} == brute_links(corpus())


def test_jaccard_tells_a_chain_from_a_triangle(spark):
    w = [f"w{i}" for i in range(100)]
    chain = [w, [f"x{i}" for i in range(10)] + w, w + [f"y{i}" for i in range(12)]]
    near = [w, ["x", *w], [*w, "y"]]
    for texts, want in ((chain, {0: 2, 1: 1, 2: 1}), (near, {0: 2, 1: 2, 2: 2})):
        rows = [(i, " ".join(t), 1, "x", "y") for i, t in enumerate(texts)]
        got = jaccard_join.links(spark.createDataFrame(rows, SCHEMA)).collect()
        assert {r.doc_id: r.n_links for r in got} == want and {r.component_id for r in got} == {0}


@pytest.mark.parametrize("size", [40, 160])
def test_jaccard_id_in_two_crowds(spark, monkeypatch, size):
    monkeypatch.setattr(jaccard_join, "FEW", 4)
    texts = lambda v, n: [" ".join([f"{v}{i}" for i in range(n)] + [f"{v}x{j}"]) for j in range(12)]
    ids = [*range(1, 12), 50], [*range(50, 62)]
    rows = [(i, t, 1, "x", "y") for group, t_ in zip(ids, (texts("a", 40), texts("b", size))) for i, t in zip(group, t_)]
    rows.append((99, "a solitary text of its own that nothing else repeats", 1, "x", "y"))
    got = jaccard_join.links(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, 99 if i == 99 else 1) for i, *_ in rows)
    assert all(r.n_links == (0 if r.doc_id == 99 else 22 if r.doc_id == 50 else 11) for r in got)


def test_substring(docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.dedup(docs).collect()}
    assert got == brute.windows(corpus())


def test_substring_check_is_independent_of_the_hash(monkeypatch):
    real = textnp.windows
    monkeypatch.setattr(textnp, "windows", lambda h, k: real(h, k) & np.uint64(255))  # of the window hash 8 bits are left
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [" ".join(f"w{i}" for i in range(60))]})
    rows = [r for b in substring_dedup._blocks(3, 1)(iter([batch])) for r in b.to_pylist()]
    assert all(r["bucket"] is None for r in rows)  # no window repeats within the buffer
    entries = [(h, c) for r in rows for h, c in zip(substring_dedup.unpack_sorted(r["hashes"]).tolist(), r["checks"])]
    assert len(entries) == len(set(entries)) == 58 and len({h for h, _ in entries}) < 58


def test_suffix(docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(docs).collect()}
    assert got == brute.suffixes(corpus())


def test_suffix_keeps_columns_and_cuts_text(docs):
    want = brute.suffixes(corpus())
    rows = suffix_dedup.clean(docs).collect()
    assert rows[0].asDict().keys() == {"doc_id", "text", "range", "ids", "component"}
    assert {r.doc_id: r.text for r in rows} == {i: v[3].decode("utf-8", "ignore") for i, v in want.items()}


@pytest.mark.parametrize("run,n", [(jaccard_join.join, 3), (substring_dedup.dedup, 5), (suffix_dedup.dedup, 6)])
def test_empty_null_and_repeated(spark, run, n):
    out = run(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and len(out.columns) == n
    long = " ".join(f"k{i}" for i in range(60_000))
    rows = [(None, long, 1, "x", "y"), (None, None, 1, "x", "y"), (5, long, 1, "x", "y"), (5, long, 1, "x", "y"), (6, "", None, None, None)]
    got = run(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and sorted(r.doc_id or -1 for r in got) == [-1, -1, 5, 5, 6]


def suffix_rows(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA).repartition(parts)
    key = lambda i: (i is None, i or 0)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(df).collect()), key=lambda x: (key(x[0]), x[1:]))
    plain = brute.suffixes(list(enumerate(t for _, t in rows)))
    return got, sorted(((i, *plain[k]) for k, (i, _) in enumerate(rows)), key=lambda x: (key(x[0]), x[1:]))


def test_suffix_at_the_threshold_and_on_periods(spark):
    r = random.Random(11)
    letters = "abcdefghij klmnop"
    text = lambda n: "".join(r.choice(letters) for _ in range(n))
    rows = []
    for k, n in enumerate((198, 199, 200, 201, 230, 260, 400)):  # a shared string of n bytes between unlike neighbours, at differing offsets
        s = text(n)
        rows += [(10 * k, text(r.randrange(90)) + "<" + s + ">" + text(r.randrange(90))), (10 * k + 1, text(r.randrange(90)) + "(" + s + ")" + text(r.randrange(90)))]
    rows += [(200, "a" * 700), (201, "ab" * 150 + text(50) + "ab" * 130), (202, "a" * 199), (203, " " * 201), (204, "é" * 150), (205, text(50) * 6), (206, text(199)), (207, text(200))]
    rows += [(300, "x" + rows[-1][1]), (301, None), (302, "")]
    got, want = suffix_rows(spark, rows)
    assert got == want


def test_suffix_on_few_letters(spark):
    r = random.Random(12)
    base = "".join(r.choice("ab") for _ in range(3000))
    rows = [(i, "".join(base[(a := r.randrange(2700)) : a + r.choice([20, 150, 210, 260])] for _ in range(r.randrange(6)))) for i in range(60)]
    got, want = suffix_rows(spark, rows, 5)
    assert got == want


def test_suffix_rows_that_share_an_id(spark):
    r = random.Random(13)
    a, b, c = (" ".join(f"{w}{r.randrange(10**6)}" for _ in range(60)) for w in "abc")
    rows = [(1, a), (2, a), (2, b), (None, c), (None, c + " more"), (None, b[:150]), (-(2**63), " ".join(reversed(c.split())))]
    got, want = suffix_rows(spark, rows)
    assert got == want and (2, len(b), 0, 0, b.encode()) in got


def test_substring_rows_that_share_an_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    low = -(2**63)
    rows = [(1, a), (2, a), (2, b), (None, c), (None, f"{c} z"), (low, "x y"), (5, b + " q"), (7, a), (7, a)]
    got = {}
    for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert got[1] == [(60, 0)] and sorted(got[2]) == [(60, 0), (60, 60)] and got[5] == [(61, 60)] and got[7] == [(60, 60)] * 2
    # One of the two texts without id has the window first, whichever sorts first.
    assert sorted(got[None]) in ([(60, 0), (61, 60)], [(60, 60), (61, 0)]) and got[low] == [(2, 0)]
