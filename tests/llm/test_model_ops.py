import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from basalt.llm import embedding_dedup, lm_scoring, mixing, packing, toxicity

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, bucket int, piece int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, 0.5, 9, 3, 7) for i, t, lang, s in rows], DOCS).repartition(3)


def texts(n=120, seed=3):
    r = random.Random(seed)
    v = [f"word{i}" for i in range(80)]
    return [(i, " ".join(r.choice(v) for _ in range(r.choice([0, 1, 5, 60, 200]))), "en", r.choice(["a", "b", "c", None])) for i in range(n)] + [(500, None, None, None), (501, "", "de", "b"), (None, "x y", "en", "a"), (502, "Word1 " * 9000, "fr", "c")]


def test_lm_counts_and_scores(spark):
    rows = texts()
    toks = [(i, brute.words((t or "").translate(brute.LOW)) + [None]) for i, t, _, _ in rows]
    c = Counter(w for i, ws in toks if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in lm_scoring.score(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, ws in toks:
        g = got[i]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(ws), sum(w in c for w in ws), n)
        assert abs(g.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 * max(1, abs(g.base_score))
        assert g.score < 0
    assert lm_scoring.score(frame(spark, rows).limit(0)).count() == 0


def test_lm_is_normalised_and_learns(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["a b c d", "e f g h"]) for _ in range(40)), "en", "s") for i in range(200)]
    got = lm_scoring.score(frame(spark, rows), epochs=2).filter("held_out").collect()
    assert sum(g.score for g in got) > sum(g.base_score for g in got) + 1
    masses = np.stack([np.full(1024, 5), np.full(1024, 2)])
    m = lm_scoring.Model(masses)
    m.w = np.random.default_rng(0).standard_normal(m.w.shape).astype(np.float32)
    ctx = np.random.default_rng(1).integers(0, 2**62, (4, 1)).astype(np.uint64)
    assert abs(np.exp(m.leaf_scores(np.repeat(ctx, 1024, 1), np.arange(1024))).sum() - 1) < 1e-4


def test_lm_learns_from_every_token():
    docs = [b"alpha beta", b"gamma", b"delta alpha epsilon", b"x y"]
    h, bounds = lm_scoring.tokens_of(docs)
    vocab, local = np.unique(h, return_inverse=True)
    block = {"ids": np.array([[1, 0], [1, 1], [1, 2], [1, 3]], np.int64).tobytes(), "hashes": lm_scoring.pack_sorted(vocab), "tokens": lm_scoring.pack(local.astype(np.int32)), "bounds": lm_scoring.pack(bounds.astype(np.int64))}
    held = lambda k: k == 3
    model = lm_scoring.Model(np.stack([np.full(1024, 5), np.full(1024, 2)]))
    touched = np.zeros(len(model.w), bool)
    for b in lm_scoring._updates(model, 0, held)(iter([pa.RecordBatch.from_pylist([block])])):
        for c, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            touched[c : c + lm_scoring.CHUNK_ROWS] = np.unpackbits(np.frombuffer(rows, np.uint8))[: len(touched[c : c + lm_scoring.CHUNK_ROWS])].astype(bool)
    ctx, leaf = lm_scoring.Model.context(h, bounds), lm_scoring.leaf_of(h)
    want = np.zeros(len(model.w), bool)
    learnt = slice(0, bounds[3])
    want[model.rows1(ctx[:, learnt])] = want[model.rows2(ctx[:, learnt], leaf[learnt] // lm_scoring.SUBCLASSES)] = True
    assert (touched == want).all()


def test_mixing(spark):
    rows = texts(4000, 9)
    got = mixing.mix(frame(spark, rows)).collect()
    again = {(r.doc_id, r.taken) for r in mixing.mix(frame(spark, rows).repartition(7)).collect()}
    assert {(r.doc_id, r.taken) for r in got} == again and len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
    total = sum(r.size for r in got)
    want = dict(zip(["a", "b", "c", None], [3, 1, 2, 3]))
    size = {s: sum(r.size for r in v) for s, v in by.items()}
    target, open_ = {}, set(size)
    while True:  # reshare the excess until none is above its cap
        left = 1.5 * total - sum(target.values())
        w = sum(want[s] for s in open_)
        over = {s for s in open_ if left * want[s] / w > 2 * size[s]}
        if not over:
            target |= {s: left * want[s] / w for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in over}
        open_ -= over
    for s, v in by.items():
        assert abs(v[0].target - target[s]) < 1e-6 * total and v[0].source_size == size[s]
        assert abs(sum(r.taken for r in v) - target[s]) <= 10
    assert mixing.mix(frame(spark, rows).limit(0)).count() == 0


def test_pivot_keeps_expected_words():
    sizes = [500, 200, 90, 80, 60, 50, 40, 30, 20, 10, 5, 3, 2, 1]
    mass = 0.3 * sum(sizes)
    runs = [mixing.pivot(list(range(s, s + len(sizes))), sizes, mass, 2, s) for s in range(2000)]
    assert all(abs(np.dot(p, sizes) + left - mass) < 1e-6 and set(p[:-2]) <= {0.0, 1.0} for p, left in runs)
    probs = np.array([mixing.pivot(list(range(s, s + 400)), [9] * 400, 0.3 * 3600, 8, s)[0] for s in range(300)])
    assert abs(probs.mean(0) - 0.3).max() < 0.12 and abs(probs.mean() - 0.3) < 1e-9


def test_rounding_keeps_every_probability_and_meets_in_pairs():
    sizes, start = [900, 300, 250, 200, 40, 39, 30, 30, 12, 9, 7, 5, 5, 3, 2, 2, 1, 1], [0.5, 0.2, 0.7, 0.4, 0.1, 0.9, 0.3, 0.6, 0.5, 0.5, 0.2, 0.8, 0.4, 0.5, 0.5, 0.3, 0.6, 0.5]
    mean, few = np.zeros(len(sizes)), np.zeros(12)
    for s in range(4000):
        prob = list(start)
        left = mixing.rounded([s * 100 + i for i in range(len(sizes))], sizes, prob, 2, s)
        assert set(prob[:-2]) <= {0.0, 1.0} and all(0 <= p <= 1 for p in prob)
        assert abs(np.dot(prob, sizes) + left - np.dot(start, sizes)) < 1e-6
        mean += prob
        prob = [0.25] * 12
        mixing.rounded([s * 50 + i for i in range(12)], [10] * 12, prob, 0, s + 7)
        few += prob
    assert abs(mean / 4000 - start)[:3].max() < 0.04  # a document's own draw is never forced
    assert abs(few / 4000 - 0.25).max() < 0.04
    prob = [0.5] * 4
    assert mixing.rounded([1, 2, 3, 4], [10, 10, 10, 10], prob, 0, 3) == 0 and sum(prob) == 2  # pairs of equal size: exactly half


def test_residuals_are_absorbed_both_ways():
    for extra in (7.0, -7.0, 500.0, -500.0):
        prob = [0.5, 0.25, 0.0, 1.0]
        rest = mixing.absorb([20, 40, 5, 5], prob, extra)
        assert abs(np.dot(prob, [20, 40, 5, 5]) + rest - (10 + 10 + 5 + extra)) < 1e-9 and prob[2:] == [0.0, 1.0]
        assert rest == 0 if abs(extra) < 20 else abs(rest) < abs(extra)


def test_mixing_edges(spark):
    rows = [(1, "a b c d", "en", "x"), (1, "a b c d", "en", "x"), (1, "other words", "en", "x"), (None, "q r s", "en", "x"), (None, None, "en", "x"), (2, None, "en", "empty"), (3, "", "en", "empty"), (4, " ".join(["w"] * 50_000), None, None)]
    rows += [(100 + i, "one two", "en", f"s{i:03}") for i in range(60)]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert [r.taken for r in got if r.source == "empty"] == [0, 0] and all(r.target == 0 for r in got if r.source == "empty")
    assert sorted((r.doc_id, r.size) for r in got if r.source == "x" and r.doc_id == 1) == [(1, 2), (1, 4), (1, 4)]
    again = mixing.mix(frame(spark, rows).repartition(5)).collect()
    key = lambda r: (r.doc_id or -1, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_packing_ids_offsets_and_count(spark):
    path = packing.tokenizer_path()
    rows = texts(300, 4) + [(700, "<|endoftext|> can't STOP é́ 中文  x", "en", "a")]
    got = packing.pack(frame(spark, rows), path).collect()
    tok = packing.WordIds(path).tokenizer
    want = {}
    for i, t, _, _ in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for p in range(0, len(ids), 2048):
            want[i, p // 2048] = (p, len(ids[p : p + 2048]), zlib.crc32(ids[p : p + 2048].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seqs) <= math.ceil(sum(r.length for r in got) / 2048) + 1
    assert packing.pack(frame(spark, rows).limit(0), path).count() == 0


def test_word_cache_gives_the_ids_of_whole_texts():
    coder = packing.WordIds(packing.tokenizer_path())
    r = random.Random(4)
    odd = ["it's", "It'S,", "don't.", "'tis", "x'", "a','", "İstanbul", "i\u0307x", "e\u0301te.", "ÉTÉ!", "<|endoftext|>", "<|endoftext|>.", "a<|startoftext|>b,", "...", "a...", "1,2.3.", "A1-b2-", "ﬁn", "Ａb", "\u00a0x", "a\u2028b", "ß,", "日本。", "x" * 300 + "!" * 30, "\x01", "a\x01.", "≠", "<\u0338.", "=\u0338", "a=\u0338", "ǅ", "ͅa", "ʼn"]
    for text in [" ".join(r.choice(odd) for _ in range(n)) for n in range(1, 60)] + odd + ["", "  ", "\n\t a"]:
        for _ in range(2):
            assert coder.encode([text.encode()])[0].tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_solver_places_every_piece():
    r = random.Random(2)
    for cap, n in ((10, 50), (100, 700), (64, 1)):
        h = Counter(r.randint(1, cap) for _ in range(n))
        bins = packing.solve(dict(h), cap)
        held = Counter()
        for items, k in bins:
            assert sum(x * a for x, a in items) <= cap
            for x, a in items:
                held[x] += a * k
        assert held == h


def test_toxicity_learns_and_handles_edges(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(1200):
        bad = i % 4 == 0
        w = [f"v{r.randrange(3000)}" for _ in range(60)] + (["Scum,", "idiot"] if bad else [])
        r.shuffle(w)
        rows.append((i, " ".join(w), r.choice(["en", "de", None]), "s"))
        labels.append((i, 1, int(bad)))
    rows += [(5000, None, None, None), (5001, "", "xx", "s"), (None, "scum idiot", "en", "s"), (5002, "calm " * 50_000, "en", "s")]
    lab = spark.createDataFrame([*labels, (1, 1, None), (99_999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r_.doc_id: r_ for r_ in toxicity.classify(frame(spark, rows), lab).collect()}
    assert len(got) == len(rows) and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.7) for g in got.values())
    held = [(got[i].predicted, t) for i, _, t in labels if toxicity.fold(i) == 1]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert got[5000].predicted == got[5001].predicted == got[5002].predicted == 0 and got[None].predicted == 1
    out = toxicity.annotate(frame(spark, rows), lab.limit(0))
    assert {x.score for x in out.select("score").collect()} == {0.0} and out.columns.count("score") == 1
    assert toxicity.classify(frame(spark, rows).limit(0), lab).count() == 0


def test_embeddings(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((300, 32))
    near = np.concatenate([base[:40] + 0.15 * r.standard_normal((40, 32)), base[:1] + 0.05 * r.standard_normal((30, 32))])
    x = np.concatenate([base, near, base[5:6], base[5:6], -base[:2]]).astype(np.float32).astype(float)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    n = len(rows)
    odd = [(n, None, 1), (n + 1, [0.0] * 32, 1), (n + 2, [None] * 32, 1), (n + 3, [float("nan")] * 32, 1), (n + 4, [], 1), (n + 5, [1.0, 0.0], 1), (n + 6, [2.0, 0.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rep int").repartition(3)
    got = {q.vec_id: q for q in embedding_dedup.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    parent = {i: i for i in range(n)}
    for i, j in zip(*np.nonzero(links)):
        a, b = sorted((brute.find(parent, i), brute.find(parent, j)))
        parent[b] = a
    assert all(got[i].n_links <= links[i].sum() for i in range(n))
    assert sum(got[i].n_links for i in range(n)) >= 0.97 * links.sum()
    assert sum(got[i].component_id == brute.find(parent, i) for i in range(n)) >= 0.97 * n
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(n, n + 5))
    assert got[n + 5].n_links == got[n + 6].n_links == 1 and not got[n + 6].kept
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_any_magnitude_and_repeated_ids(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 0.0]), (3, [1e-200, 1e-200]), (4, [2e-200, 2e-200]), (5, [1e308, 1e308]), (6, [5e-324, 0.0]), (6, [5e-324, 0.0]), (7, [float("inf"), 1.0]), (None, [1.0, 0.0]), (8, [-1e300, 0.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    told = {r.vec_id: (r.n_links, r.component_id) for r in got}
    assert {told[i] for i in (1, 2)} == {(3, 1)} and told[6] == (3, 1) and {told[i] for i in (3, 4, 5)} == {(2, 3)}
    assert told[7] == (0, 7) and told[8] == (0, 8) and told[None] == (0, None)


def test_toxicity_scores_against_a_plain_network(spark):
    r = random.Random(8)
    docs = [" ".join(r.choice(["Calm", "day,", "idiot!", "scum", "über-x", "a1"]) for _ in range(n)) for n in (0, 1, 2, 3, 7, 40)] + ["", None, "one", "...,;"]
    examples = [(toxicity.word_ids([d.encode()])[0], k % 2, "en", k % 5 == 0) for k, d in enumerate([f"{'scum' if i % 2 else 'calm'} day {i}" for i in range(60)])]
    net = toxicity.fit(examples)
    got = net.scores(*toxicity.word_ids([(d or "").encode() for d in docs]))
    for d, s in zip(docs, got):
        words = [w for w in brute.re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (d or "").translate(brute.LOW)) if w]
        x = []
        for w in words:
            h = int(toxicity.word_ids([w.encode()])[0][0])
            x.append(net.emb[0, h % toxicity.ROWS] + net.emb[1, (h * 0x9E3779B1 % 2**32) >> (32 - toxicity.BITS)])
        pooled = []
        for w, k in net.conv.items():
            values = [np.concatenate(x[a : a + w]) @ k + net.bias[w] for a in range(len(x) - w + 1)]
            pooled += list(np.maximum(np.max(values, 0), 0)) if values else [0.0] * k.shape[1]
        z = float(np.dot(pooled, net.out) + net.b)
        assert abs(s - 1 / (1 + math.exp(-max(-40, min(40, z * net.scale + net.shift))))) < 1e-4


def test_toxicity_sample_is_bounded_in_rows_and_words(spark):
    rows = [(i, "bad " * 50 if i % 2 else "good " * 50, "en", "s") for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(4, 0), (4, 1)], "doc_id long, toxic int")
    some = toxicity.sample(frame(spark, rows), labels, 20, 100_000)
    assert sum(e[1] for e in some) <= 20 and sum(1 - e[1] for e in some) <= 20 and len(some) > 30
    few = toxicity.sample(frame(spark, rows), labels, 100, 500)
    assert {e[1] for e in few} == {0, 1} and sum(len(e[0]) for e in few) <= 600
    again = toxicity.sample(frame(spark, rows).repartition(7), labels, 100, 500)
    assert [(e[1], e[0].tobytes()) for e in few] == [(e[1], e[0].tobytes()) for e in again]
