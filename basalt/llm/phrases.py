"""Phrase collocation mining over dictionary ids.

Texts are split into pieces, and pieces into words. Map tasks turn blocks of texts into numbers of a dictionary of
their own (``_blocks``); Spark counts the words of all dictionaries by language, gives the frequent ones an id each, and
returns to every block the ids of its words. Rare words break their pieces, as no phrase with one can be
frequent. Runs of two and three ids become fixed-width binary keys (a 64-bit pair and a 32-bit third word), which a block
sorts by radix, counts by run length, and deals out by ranges of the scrambled pair (``_keys``); each range sorts and counts again (``_runs``).
Scores, coverage and ranks are joins and windows over the frequent phrases, in decimals of 38 digits.

What moves: each word once for a block that has it, the ids of a block, and each distinct phrase once for a block, as packed
arrays. A frequent word or phrase therefore costs one entry to a block. Triples whose pair consists of two words that
hold more than 1/1024 of all words are dealt by all three words, so that a pair that follows everywhere fills no single range; ranges follow the
number of words. Phrases are told apart by their ids, words by their bytes: nothing is hashed without its inverse.

Null texts are empty, null languages are ``und`` (as is a language of that name); texts without words add
nothing. Repeated rows count each, whatever their ids. Equal scores and counts rank by the bytes of the phrase. Very long texts are one block. An empty table
gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textnp
from .common import checkpoint_dir, cut, lean, remove, shuffle_partitions, table
from .packed import pack, pack_sorted, range_cuts, unpack, unpack_sorted

UNKNOWN = "und"
#: Least occurrences of a phrase; percentage of its occurrences at which a longer one replaces it; phrases returned of a language.
LEAST, COVER, TOP = 10, 50, 2000
#: Bytes of text to a block; phrases of blocks that one range should sort; share of all words from which a word is a hot one.
BLOCK_BYTES = 6 << 20
RANGE_KEYS = 2_000_000
HOT = 1024

SOFT, HARD = b" \t", b".,;:!?\n\x0b\x0c\r"
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(SOFT)], _CLASS[list(HARD)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK = pa.schema([("block", pa.int64()), ("number", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("words", pa.binary()), ("joined", pa.binary())])
_INVERSES = (np.uint64(pow(0xA0761D6478BD642F, -1, 2**64)), np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64)))


def unmix(h: np.ndarray) -> np.ndarray:
    """The inverse of textnp.mix."""
    h = h ^ (h >> np.uint64(32))
    h = h * _INVERSES[0]
    h = h ^ (h >> np.uint64(29)) ^ (h >> np.uint64(58))
    h = h * _INVERSES[1]
    return h ^ (h >> np.uint64(32))


def radix(*keys: np.ndarray) -> np.ndarray:
    """The order of unsigned keys, the last one leading: stable passes over their 16-bit digits, without those that are all alike."""
    order = None
    for k in keys:
        for digit in range(k.itemsize // 2):
            d = (k >> k.dtype.type(16 * digit)).astype(np.uint16)
            if len(d) and d.min() != d.max():
                order = np.argsort(d, kind="stable") if order is None else order[np.argsort(d[order], kind="stable")]
    return np.arange(len(keys[0])) if order is None else order


def tokenized(docs: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Lower-cased words of all texts, the text of each, and whether the next word follows in the same piece."""
    buf = _LOWER[np.frombuffer(b"\n" + b"\n".join(docs) + b"\n", np.uint8)]
    kind = _CLASS[buf]
    solid = kind == 0
    edge = np.diff(solid.view(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    joined = np.append(piece[1:] == piece[:-1], False)[: len(starts)]
    at = np.cumsum(np.fromiter((len(d) + 1 for d in docs), np.int64, len(docs)))
    of = np.searchsorted(at, starts, "right")
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buf[solid])])
    return words.dictionary_encode(), of, joined


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every block its dictionary, one row to a word, and one row with its words as numbers of the dictionary."""
    block = TaskContext.get().partitionId() << 32

    def flush(docs: list[bytes], langs: list[str]) -> Iterator[pa.RecordBatch]:
        nonlocal block
        words, of, joined = tokenized(docs)
        if not len(words):
            return
        names = sorted(set(langs))
        code = {x: i for i, x in enumerate(names)}
        code = np.array([code[x] for x in langs], np.int64)[of]
        own, numbers, n = np.unique(code * len(words.dictionary) + words.indices.to_numpy(), return_inverse=True, return_counts=True)
        columns = [
            pa.array(np.full(len(own), block)),
            pa.array(np.arange(len(own), dtype=np.int32)),
            pa.array(names).take(pa.array(own // len(words.dictionary))),
            words.dictionary.take(pa.array(own % len(words.dictionary))).cast(pa.binary()).cast(pa.string()),
            pa.array(n),
            *(pa.nulls(len(own), pa.binary()) for _ in range(2)),
        ]
        found = pa.RecordBatch.from_arrays(columns, schema=_BLOCK)
        for i in range(0, len(own), 1 << 15):
            yield found.slice(i, 1 << 15)
        one = [[block], [None], [None], [None], [len(words)], [pack(numbers.astype(np.int32))], [pack(np.packbits(joined))]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(one, _BLOCK)], schema=_BLOCK)
        block += 1

    docs, langs, size = [], [], 0
    for b in batches:
        for t, lang in zip(textnp.texts(b.column("text")), b.column("lang").to_pylist()):
            docs.append(t)
            langs.append(lang)
            size += len(t)
            if size >= BLOCK_BYTES:
                yield from flush(docs, langs)
                docs, langs, size = [], [], 0
    if docs:
        yield from flush(docs, langs)


def _rows(kind: int, at: np.ndarray, pair: np.ndarray, third: np.ndarray, n: np.ndarray) -> list[tuple]:
    """Ascending keys as packed blocks, one to a range; ``at``: where ranges begin and end."""
    rows = []
    for r in np.flatnonzero(np.diff(at)).tolist():
        s = slice(at[r], at[r + 1])
        first = np.flatnonzero(np.concatenate(([True], pair[s][1:] != pair[s][:-1])))
        rows.append((r, kind, pack_sorted(pair[s][first]), pack(np.diff(first, append=s.stop - s.start).astype(np.int32)), pack(third[s]), pack(n[s].astype(np.uint32))))
    return rows


def _keys(ranges: int):
    """A block's phrases as sorted keys with their counts. Kind 0 counts pairs and triples (third word 0: none), kind 1 triples alone."""

    def run(block: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        for words, joined in zip(block["words"], block["joined"]):
            number = unpack(words, np.int32)
            joined = np.unpackbits(unpack(joined, np.uint8))[: len(number)].astype(bool)
            of, hot = np.zeros(int(number.max()) + 1, np.uint64), np.zeros(int(number.max()) + 1, bool)
            of[known["number"]], hot[known["number"]] = known["id"].astype(np.uint64), known["hot"].astype(bool)
            ids, hot = of[number], hot[number]
            ok = (ids[:-1] > 0) & (ids[1:] > 0) & joined[:-1]
            p = np.flatnonzero(ok)
            third = np.where(np.append(ok[1:], False)[p], np.append(ids, 0)[p + 2], 0).astype(np.uint32)
            pair, hot = textnp.mix(ids[p] << np.uint64(32) | ids[p + 1]), hot[p] & hot[p + 1]
            order = radix(third, pair)
            pair, third, hot = pair[order], third[order], hot[order]
            if not len(pair):
                continue
            first = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (third[1:] != third[:-1]))))
            n = np.diff(first, append=len(pair))
            pair, third, hot = pair[first], third[first], hot[first]
            # A hot pair goes on as one entry, and its triples by all three words.
            start = np.flatnonzero(np.concatenate(([True], ~hot[1:] | (pair[1:] != pair[:-1]))))
            total = np.add.reduceat(n, start)
            rows += _rows(0, range_cuts(pair[start], ranges), pair[start], np.where(hot[start], 0, third[start]), total)
            t = np.flatnonzero(hot & (third > 0))
            if len(t):
                place = (textnp.mix(pair[t] ^ textnp.mix(third[t].astype(np.uint64))) >> np.uint64(32)).astype(np.int64) * ranges >> 32
                t = t[np.argsort(place, kind="stable")]
                rows += _rows(1, np.searchsorted(np.sort(place), np.arange(ranges + 1)), pair[t], third[t], n[t])
        return pd.DataFrame(rows, columns=["range", "kind", "pairs", "runs", "thirds", "n"])

    return run


def _runs(least: int):
    """Frequent phrases of one range, by run length over its sorted keys."""

    def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = radix(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        total = np.add.reduceat(n[order], first) if len(first) else np.empty(0, np.int64)
        return key[first], total

    def run(group: pd.DataFrame) -> pd.DataFrame:
        pair = np.concatenate([np.repeat(unpack_sorted(k), unpack(r, np.int32)) for k, r in zip(group["pairs"], group["runs"])])
        third = np.concatenate([unpack(x, np.uint32) for x in group["thirds"]]).astype(np.uint64)
        n = np.concatenate([unpack(x, np.uint32) for x in group["n"]]).astype(np.int64)
        both = np.repeat(group["kind"].to_numpy() == 0, [int.from_bytes(x[:8], "little") // 4 for x in group["n"]])
        two, a = summed(pair[both], n[both])
        out = [(unmix(two[a >= least]), np.zeros((a >= least).sum(), np.uint64), a[a >= least])]
        # Pairs as ranks, so that a triple is one 64-bit key.
        pair, third, n = pair[third > 0], third[third > 0], n[third > 0]
        order = radix(pair)
        new = np.concatenate(([False], pair[order][1:] != pair[order][:-1])) if len(pair) else np.empty(0, bool)
        rank = np.empty(len(pair), np.uint64)
        rank[order] = np.cumsum(new)
        distinct = pair[order][np.concatenate(([True], new[1:]))] if len(pair) else pair
        three, a = summed(rank << np.uint64(32) | third, n)
        three, a = three[a >= least], a[a >= least]
        out.append((unmix(distinct[(three >> np.uint64(32)).astype(np.int64)]), three & np.uint64(0xFFFFFFFF), a))
        pair, third, a = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"i1": (pair >> np.uint64(32)).astype(np.int64), "i2": (pair & np.uint64(0xFFFFFFFF)).astype(np.int64), "i3": third.astype(np.int64), "a": a})

    return run


def _dictionary(words: DataFrame, least: int) -> DataFrame:
    """lang, word, f, id: the frequent words of every language; ids are dense from 1."""
    frequent = cut(words.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least).withColumn("m", F.monotonically_increasing_id()))
    part = F.shiftright("m", 33)
    sizes = frequent.groupBy(part.alias("p")).count().orderBy("p").collect()  # a row for each partition
    starts, at = {}, 1
    for r in sizes:
        starts[r.p], at = at, at + r["count"]
    if at >= 2**32:
        raise ValueError("more than 2**32 frequent words")
    offsets = F.create_map(*(F.lit(x) for kv in starts.items() for x in kv)) if starts else F.create_map(F.lit(0), F.lit(0))
    return frequent.select("lang", "word", "f", (F.element_at(offsets, part.cast("int")) + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("id"))


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(i1, i2, i3, a): all phrases of two (i3 = 0) and three words with at least ``least`` occurrences; the dictionary (id, lang, word, f); (lang, n)."""
    spark = docs.sparkSession
    place = f"{checkpoint_dir(spark)}/phrases-{uuid.uuid4().hex}"
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    rows.mapInArrow(lean(_blocks), "block long, number int, lang string, word string, n long, words binary, joined binary").write.parquet(place)
    words = spark.read.parquet(place).filter("word IS NOT NULL").select("block", "number", "lang", "word", "n")
    sizes = cut(words.groupBy("lang").agg(F.sum("n").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    dictionary = _dictionary(words, least)
    known = words.join(dictionary, ["lang", "word"]).select("block", "number", "id", (F.col("f") * HOT > total).alias("hot"))
    ranges = max(shuffle_partitions(spark), -(-total // RANGE_KEYS))
    blocks = spark.read.parquet(place).filter("words IS NOT NULL").select("block", "words", "joined")
    keys = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(_keys(ranges), "range int, kind int, pairs binary, runs binary, thirds binary, n binary")
    found = cut(keys.groupBy("range").applyInPandas(_runs(least), "i1 long, i2 long, i3 long, a long"))
    remove(spark, place)
    return found, dictionary, sizes


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) in decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def scored(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score and ``covered`` (largest count of a longer candidate around it) of every candidate."""
    word = lambda i: dictionary.select(F.col("id").alias(f"i{i}"), F.col("word").alias(f"w{i}"), F.col("f").alias(f"f{i}"), *(["lang"] if i == 1 else []))
    pairs, triples = found.filter("i3 = 0").drop("i3"), found.filter("i3 > 0")
    around = triples.select("i1", "i2", "a").unionAll(triples.select(F.col("i2").alias("i1"), F.col("i3").alias("i2"), "a")).groupBy("i1", "i2").agg(F.max("a").alias("covered"))
    two = pairs.join(around, ["i1", "i2"], "left").join(word(1), "i1").join(word(2), "i2")
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"), "covered")
    three = triples.join(pairs.withColumnRenamed("a", "f12"), ["i1", "i2"]).join(pairs.select(F.col("i1").alias("i2"), F.col("i2").alias("i3"), F.col("a").alias("f23")), ["i2", "i3"])
    three = three.join(word(1), "i1").join(word(2), "i2").join(word(3), "i3").withColumns({"s1": _score(F.col("a"), F.col("f1"), F.col("f23")), "s2": _score(F.col("a"), F.col("f12"), F.col("f3"))})
    late = F.col("s2") < F.col("s1")
    pick = lambda x, y: F.when(late, F.col(x)).otherwise(F.col(y))
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", pick("f12", "f1").alias("l"), pick("f3", "f23").alias("r"), F.least("s1", "s2").alias("score"), F.lit(None).cast("long").alias("covered"))
    return two.unionAll(three)


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language that no longer candidate covers by ``cover`` percent."""
    found, dictionary, sizes = frequent_phrases(docs, least)
    open_ = scored(found, dictionary).filter(F.col("covered").isNull() | (F.col("covered").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * cover)).drop("covered")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(docs.sparkSession)))
    first = open_.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, list_slice(w, i, i + k - 1) AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS t(k) WHERE len(w) >= k)),
f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY lang, g HAVING count(*) >= 10),
c AS (
  SELECT p.lang, p.g, p.f AS a, x.f AS l, y.f AS r, k, (1000000::HUGEINT * p.f * p.f) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1) AS p
  JOIN f AS x ON x.lang = p.lang AND x.g = list_slice(p.g, 1, k)
  JOIN f AS y ON y.lang = p.lang AND y.g = list_slice(p.g, k + 1, len(p.g))),
best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
around AS (
  SELECT lang, g, max(a) AS a
  FROM (SELECT lang, list_slice(g, 1, 2) AS g, a FROM best WHERE len(g) = 3 UNION ALL SELECT lang, list_slice(g, 2, 3), a FROM best WHERE len(g) = 3)
  GROUP BY lang, g)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, b.score
      FROM best AS b LEFT JOIN around AS o ON o.lang = b.lang AND o.g = b.g WHERE o.a IS NULL OR 100 * o.a < 50 * b.a)
JOIN n USING (lang)
QUALIFY rank <= 2000
"""
