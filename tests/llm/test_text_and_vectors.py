"""Whitening, language identification and phrase mining against plain versions."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from basalt.llm import language_id, phrases, whitening

from . import brute

VEC = "vec_id long, embedding array<double>, label int, n int, whitened string, deviation int, x int"
DOC = "doc_id long, text string, lang string, source string, lang_pred int, score string, n long, word string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "w", 3, 4) for i, v in rows], VEC).repartition(3)


def plain_whitening(rows, k=4):
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = Counter(len(x) for x in {tuple(x) for _, x in good}).most_common(1)[0][0]
    good = [(i, x) for i, x in good if len(x) == dim]
    fitted = sorted({tuple(x) for _, x in good})
    n, s = len(fitted), [sum(c) for c in zip(*fitted)]
    centred = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(x, s)] for x in fitted])
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    out = {}
    for i, x in good:
        dev = [n * c - t for c, t in zip(x, s)]
        out.setdefault((i, tuple(x)), (sum(d * d for d in dev), [float(np.dot(np.array(dev) / n, q[:, -j - 1]) / math.sqrt(e[-j - 1])) for j in range(min(k, dim))]))
    return n, out, e[::-1][:k] / e.sum()


def test_whitening_against_plain(spark):
    r = random.Random(5)
    shape = [9, 5, 3, 1, 0.5]
    rows = [(i, [r.gauss(0.3, s) for s in shape]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(7, rows[3][1]), (None, rows[4][1]), (600, rows[5][1])]
    bad = [(700, None), (701, [1.0, None, 2.0, 3.0, 4.0]), (702, [math.nan] * 5), (703, [math.inf, 0.0, 0.0, 0.0, 0.0]), (704, []), (705, [1.0, 2.0]), (706, [1e300, 0.0, 0.0, 0.0, 0.0])]
    n, want, share = plain_whitening(rows)
    df = vectors(spark, rows + bad)
    model = whitening.fit(df)
    assert model.n == n == 300 and model.identity_error < 1e-9
    assert np.allclose(model.explained(), share, rtol=1e-9)
    got = whitening.transform(df, model).collect()
    assert Counter(g.vec_id for g in got) == Counter(i for i, _ in rows)
    sign = None
    for g in got:
        dev, white = want[(g.vec_id, tuple(math.floor(256 * c) for c in g.embedding))]
        assert g.deviation == dev
        if sign is None:
            sign = np.sign(np.array(g.whitened) / white)
        assert np.allclose(np.array(g.whitened) * sign, white, atol=1e-9)
    assert got[0].label == 1 and got[0].x == 4


def test_whitening_query_columns_and_odd_tables(spark, tmp_path):
    rows = [(i, [float(i % 7), float(i % 5), float(i % 3)]) for i in range(105)]
    vectors(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.query(spark, str(tmp_path)).toPandas()
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 105 * 3 and set(got["component"]) == {1, 2, 3} and got["identity_error"].nunique() == 1
    assert [whitening.query(spark, str(tmp_path)).schema[c].dataType.simpleString() for c in ("vec_id", "component", "n", "deviation")] == ["bigint", "int", "bigint", "bigint"]
    assert abs(got.groupby("component")["explained"].first().sum() - 1) < 1e-9
    # One vector, many times: nothing varies.
    df = vectors(spark, [(i, [1.0, 2.0]) for i in range(9)])
    model = whitening.fit(df)
    out = whitening.transform(df, model).collect()
    assert model.n == 1 and len(out) == 9 and all(o.deviation == 0 and o.whitened == [None, None] for o in out)
    # Of rank one: the second component has no variance.
    df = vectors(spark, [(i, [float(i), float(i)]) for i in range(9)])
    out = whitening.transform(df, whitening.fit(df)).collect()
    assert all(o.whitened[0] is not None and o.whitened[1] is None for o in out)
    for none in ([], [(1, None), (2, []), (3, [math.nan])]):
        df = vectors(spark, none)
        assert whitening.transform(df, whitening.fit(df)).count() == 0


def test_whitening_is_exact_beyond_64_bits():
    x = np.array([[2**62, -(2**62)], [5, 7]], np.int64)
    assert whitening.deviations(x, 10, [3, 4]).tolist() == [[10 * 2**62 - 3, -10 * 2**62 - 4], [47, 66]]
    assert len(set(whitening.encoded(np.array([[1, 2], [1, 2], [40000, 2], [2**40, 2]])))) == 3


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "x", 5, "w") for i, t, lang in rows], DOC).repartition(3)


def plain_cells(text):
    """n-grams of words with borders, as a multiset of strings."""
    words = [w for w in "".join(c if c.isalpha() else " " for c in text.lower()).split(" ") if w]
    out = Counter()
    for w in words:
        b = f" {w} "
        out.update(w)
        out.update(b[i : i + 2] for i in range(len(b) - 1))
        out.update(b[i : i + 3] for i in range(len(b) - 2))
    return out


def test_language_cells_are_the_ngrams():
    docs = ["Häuser  an--der Straße 7", None, "", "...", "a", "İstanbul x2y", "日本語 テスト"]
    h, of = language_id.cells(docs)
    for d, text in enumerate(docs):
        want = plain_cells(text or "")
        assert (of == d).sum() == sum(want.values())
        assert sorted(Counter(h[of == d].tolist()).values()) == sorted(want.values())


def lang_rows(n=160, seed=2):
    r = random.Random(seed)
    letters = {"en": "the of and tion ing wh", "de": "der und sch ung ein ß", "fr": "le ou eau é ment ç"}
    rows = []
    for i in range(n):
        lang = r.choice(["en", "en", "de", "fr"])
        parts = letters[lang].split(" ")
        rows.append((i, " ".join(r.choice(parts) + r.choice(parts) for _ in range(r.choice([3, 20, 60]))), lang))
    return rows


def test_language_id_against_plain_bayes(spark, tmp_path):
    odd = [(900, None, "en"), (901, "", "de"), (902, "12 ?!", "fr"), (903, "the of", None), (None, "der und der und", "de"), (904, "the ouing " * 9000, "en"), (3, "le eau", "fr")]
    rows = lang_rows() + odd
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = language_id.query(spark, str(tmp_path)).toPandas()
    assert list(got.columns) == ["doc_id", "held_out", "lang_pred", "score"] and len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    counts, texts = {}, Counter()
    for i, t, lang in rows:
        c = plain_cells(t or "")
        if not held(i) and lang is not None and c:
            counts.setdefault(lang, Counter()).update(c)
            texts[lang] += 1
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    by = {(None if pd.isna(r.doc_id) else int(r.doc_id), r.lang_pred): r for r in got.itertuples()}
    for i, t, _ in rows:
        c = plain_cells(t or "")
        if not c:
            assert by[(i, "und")].score == 0.0
            continue
        logs = {lang: math.log(texts[lang]) + sum(m * math.log((counts[lang][g] + 0.1) / (total[lang] + 0.1 * language_id.BUCKETS)) for g, m in c.items()) for lang in counts}
        best = max(logs, key=lambda x: (logs[x], x))
        assert (i, best) in by and abs(by[(i, best)].score - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-3
    assert all(r.held_out == held(None if pd.isna(r.doc_id) else int(r.doc_id)) for r in got.itertuples())
    hits = [r.lang_pred == lang for r in got.itertuples() for i, _, lang in rows[:160] if r.doc_id == i and held(i)]
    assert len(hits) > 20 and np.mean(hits) > 0.95


def test_language_id_without_languages_and_long_texts(spark, monkeypatch):
    df = documents(spark, [(1, "some text", None), (2, None, "en")])
    out = language_id.annotate(df, language_id.fit(df)).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)] * 2 and out[0].source == "s"
    assert language_id.annotate(df.limit(0), language_id.fit(df.limit(0))).count() == 0
    model = language_id.fit(documents(spark, lang_rows(60)))
    text = " ".join(t for _, t, lang in lang_rows(60) if lang == "de")
    whole = model.predict([text])
    monkeypatch.setattr(language_id, "SLICE_BYTES", 100)
    assert model.predict([text])[0] == whole[0] and abs(model.predict([text])[1] - whole[1]).max() < 1e-9
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(documents(spark, lang_rows(60)))


def plain_phrases(rows, least=10, cover=50, top=2000):
    f, n = {}, Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(brute.LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rank = []
        for p, a in cand.items():
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= cover * a and p in (q[:2], q[1:]) for q, b in cand.items()):
                rank.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (score, a, p, left, right) in enumerate(sorted(rank)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def phrase_rows(n=150, seed=4):
    r = random.Random(seed)
    v = [f"w{i}" for i in range(25)] + ["New", "york", "ćity", "a|b", " ", "x y"]
    rows = []
    for i in range(n):
        words = [r.choice(v) if r.random() > 0.2 else "New York ćity" for _ in range(r.choice([0, 1, 2, 40, 90]))]
        rows.append((i, "".join(w + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for w in words), r.choice(["en", "en", "de", None, "und"])))
    return rows + [(500, None, "en"), (501, "", None), (502, "hot pair " * 4000, "en"), (None, "a a a a a a a a a a a a a a a", "de"), (None, "a a a", "de")]


@pytest.mark.parametrize("hot", [1024, 3, 10**9])
def test_phrases_against_plain(spark, monkeypatch, hot):
    monkeypatch.setattr(phrases, "HOT", hot)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 2000)
    rows = phrase_rows() + [(600 + i, phrase_rows()[5][1], "en") for i in range(30)]
    got = phrases.collocations(documents(spark, rows))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert all(f.dataType.simpleString() == ("string" if f.name in ("lang", "phrase") else "bigint") for f in got.schema)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows)


def test_phrases_top_ties_and_empty(spark):
    rows = phrase_rows()
    assert sorted(map(tuple, phrases.collocations(documents(spark, rows), least=2, cover=100, top=7).collect())) == plain_phrases(rows, 2, 100, 7)
    assert phrases.collocations(documents(spark, rows[:0])).count() == 0
    assert phrases.collocations(documents(spark, [(1, "only once", "en"), (2, None, None)])).count() == 0


def test_phrase_keys():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 2**63, 5000).astype(np.uint64) % np.uint64(50) << np.uint64(40), r.integers(0, 9, 5000).astype(np.uint32)
    assert (phrases.radix(b, a) == np.lexsort((b, a))).all()
    x = r.integers(0, 2**63, 1000).astype(np.uint64)
    assert (phrases.unmix(phrases.textnp.mix(x)) == x).all()


def test_phrase_scores_pass_64_bits(spark):
    big = 2_000_000_000_000
    found = spark.createDataFrame([(1, 2, 0, big), (2, 3, 0, big + 5), (1, 2, 3, big - 7)], "i1 long, i2 long, i3 long, a long")
    words = spark.createDataFrame([(i, "en", f"w{i}", big + 10 * i) for i in (1, 2, 3)], "id long, lang string, word string, f long")
    got = {r.phrase: r for r in phrases.scored(found, words).collect()}
    assert got["w1 w2"].score == 1000000 * big * big // ((big + 10) * (big + 20)) and got["w1 w2"].covered == big - 7
    a, cuts = big - 7, [(big + 10, big + 5), (big, big + 30)]
    assert got["w1 w2 w3"].score == min(1000000 * a * a // (x * y) for x, y in cuts)
