"""Comparison of two snapshots of findings, edges or censuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut
from ..functions.text import normalized_source


def _unique(df: DataFrame, key: str) -> DataFrame:
    once = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_c")).filter("_c = 1").select(key)
    return df.join(once, key, "left_semi")


def pair(base: DataFrame, head: DataFrame, keys: tuple[str, ...] = ("id", "content_key", "location_key")) -> DataFrame:
    """(base_row, head_row, by): findings carried over by the first key that is unique on both sides of what is left. Both need row, and the keys."""
    left_b, left_h, out = base, head, None
    for k in keys:
        b = _unique(left_b, k).select(F.col("row").alias("base_row"), k)
        h = _unique(left_h, k).select(F.col("row").alias("head_row"), k)
        got = cut(b.join(h, k).select("base_row", "head_row", F.lit(k).alias("by")))
        out = got if out is None else out.unionByName(got)
        left_b = left_b.join(got.select(F.col("base_row").alias("row")), "row", "left_anti")
        left_h = left_h.join(got.select(F.col("head_row").alias("row")), "row", "left_anti")
    return out


def compare(base: DataFrame, head: DataFrame, keys: tuple[str, ...] = ("id", "content_key", "location_key")) -> DataFrame:
    """row, side, status: carried, introduced, resolved, or absorbed (gone, but its place is in another finding of the head)."""
    p = pair(base, head, keys)
    carried = p.select(F.col("head_row").alias("row"), F.lit("head").alias("side"), F.lit("carried").alias("status"))
    new = head.join(p.select(F.col("head_row").alias("row")), "row", "left_anti").select("row", F.lit("head").alias("side"), F.lit("introduced").alias("status"))
    gone = base.join(p.select(F.col("base_row").alias("row")), "row", "left_anti")
    places = head.select("file", F.col("start_line").alias("_a"), F.col("end_line").alias("_b"), "kind")
    eaten = gone.join(places, ["file", "kind"]).filter("start_line >= _a AND end_line <= _b").select("row").distinct().withColumn("_in", F.lit(True))
    old = gone.join(eaten, "row", "left").select("row", F.lit("base").alias("side"), F.when(F.col("_in"), F.lit("absorbed")).otherwise(F.lit("resolved")).alias("status"))
    return carried.unionByName(new).unionByName(old)


def with_content(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Adds content_key: the kind and the normalised source of a finding's lines, which a move or a rename of its file leaves as it is.

    findings: file, kind, start_line, end_line; files: path, content. Null where the file or the lines are not known.
    """
    lines = F.slice(F.split("content", "\n"), F.greatest(F.col("start_line"), F.lit(1)), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)))
    text = normalized_source(F.array_join(lines, "\n"))
    j = findings.join(files.select(F.col("path").alias("file"), "content"), "file", "left")
    return j.withColumn("content_key", F.when(text != "", F.sha1(F.concat_ws("\n", "kind", text).cast("binary")))).drop("content")


def partially_introduced(pairs: DataFrame, base: DataFrame, head: DataFrame) -> DataFrame:
    """row, new_places: findings that were carried over and have places in the head that the base's finding had not, or not as often.

    pairs: base_row, head_row; base and head: row, place, one row to a place of a finding. Places are compared as multisets, by a key that the caller
    chooses (content, or file and symbol).
    """
    count = lambda d, side, n: d.join(pairs.select(F.col(f"{side}_row").alias("row"), F.col("head_row").alias("_of")), "row").groupBy("_of", "place").agg(F.count("*").alias(n))
    j = count(head, "head", "h").join(count(base, "base", "b"), ["_of", "place"], "left").withColumn("more", F.col("h") - F.coalesce("b", F.lit(0))).filter("more > 0")
    return j.groupBy(F.col("_of").alias("row")).agg(F.sum("more").cast("long").alias("new_places"))


def touched(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings in changed files."""
    return findings.join(changed.select("file").distinct(), "file", "left_semi")


def unreliable(base: DataFrame, head: DataFrame, anchor: str = "anchor") -> DataFrame:
    """Anchors with several findings whose number moved."""
    b, h = (d.groupBy(anchor).agg(F.count("*").alias(n)) for d, n in ((base, "b"), (head, "h")))
    return b.join(h, anchor, "full_outer").select(anchor, F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("h", F.lit(0)).alias("h")).filter("b <> h AND greatest(b, h) > 1")


def edge_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """src, dst, kind, status of edges that are on one side only: one aggregation that notes the sides of every edge."""
    k = ["src", "dst", "kind"]
    both = base.select(*k, F.lit(1).alias("_side")).unionByName(head.select(*k, F.lit(2).alias("_side")))
    sides = both.groupBy(*k).agg(F.bit_or("_side").alias("_sides")).filter("_sides <> 3")
    return sides.select(*k, F.when(F.col("_sides") == 2, F.lit("added")).otherwise(F.lit("removed")).alias("status"))


def census(findings: DataFrame) -> DataFrame:
    """key ``file|hallazgo:kind``, n: a multiset that survives reordering."""
    return findings.groupBy(F.concat("file", F.lit("|hallazgo:"), "kind").alias("key")).agg(F.sum(F.coalesce("member_count", F.lit(1))).cast("long").alias("n"))


def census_diff(base: DataFrame, head: DataFrame, waivers: DataFrame | None = None) -> DataFrame:
    """key, base_n, head_n, change, waived. A waiver's key may hold one star; it covers losses (baja, desaparece) down to its min."""
    j = base.select("key", F.col("n").alias("base_n")).join(head.select("key", F.col("n").alias("head_n")), "key", "full_outer").select("key", F.coalesce("base_n", F.lit(0)).alias("base_n"), F.coalesce("head_n", F.lit(0)).alias("head_n"))
    change = F.when(F.col("head_n") < F.col("base_n"), F.when(F.col("head_n") == 0, F.lit("desaparece")).otherwise(F.lit("baja"))).when(F.col("head_n") > F.col("base_n"), F.lit("sube")).otherwise(F.lit("igual"))
    j = j.withColumn("change", change)
    if waivers is None:
        return j.withColumn("waived", F.lit(False))
    w = waivers.select(F.col("key").alias("pattern"), "expected", F.coalesce("min", F.lit(0)).alias("least"))
    covers = (F.col("change") == F.col("expected")) & (F.col("head_n") >= F.col("least"))
    part = F.split(F.col("pattern"), r"\*", 2)
    starred = w.filter(F.col("pattern").contains("*")).withColumns({"head_part": F.get(part, F.lit(0)), "tail_part": F.coalesce(F.get(part, F.lit(1)), F.lit(""))})
    # Only losses meet the waivers: whole keys by equality, patterns one by one.
    lost = j.filter(F.col("change").isin("baja", "desaparece"))
    exact = lost.join(w.filter(~F.col("pattern").contains("*")), (F.col("key") == F.col("pattern")) & covers).select("key")
    fits = lost.join(starred, F.col("key").startswith(F.col("head_part")) & F.col("key").endswith(F.col("tail_part")) & covers).select("key")
    ok = exact.unionByName(fits).distinct().withColumn("waived", F.lit(True))
    return j.join(ok, "key", "left").withColumn("waived", F.coalesce("waived", F.lit(False)))


def change_summary(compared: DataFrame) -> DataFrame:
    return compared.groupBy("status").agg(F.count("*").alias("n"))
