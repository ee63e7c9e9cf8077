"""Source trees as a table: scan, exclusion, language, content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, extension, segments

#: Pruned folders, in alphabetical order.
PRUNED = (
    ".bundle", ".cache", ".git", ".next", ".nuxt", ".venv", "Godeps", "__pycache__", "_build", "bower_components", "build", "coverage", "deps", "dist", "dist-packages",
    "jspm_packages", "log", "node_modules", "obj", "out", "public", "site-packages", "storage", "target", "third-party", "third_party", "thirdparty", "tmp", "vendor", "venv", "web_modules",
)
#: Languages by extension.
LANGUAGES = {
    "csharp": (".cs",), "elixir": (".ex", ".exs"), "go": (".go",), "java": (".java",), "javascript": (".cjs", ".js", ".jsx", ".mjs"), "python": (".py",),
    "ruby": (".rake", ".rb"), "rust": (".rs",), "tsx": (".tsx",), "typescript": (".cts", ".mts", ".ts"), "vue": (".vue",),
}
#: Names that code generators write, and the marks that they leave in the first lines.
GENERATED_SUFFIXES = (".designer.cs", ".freezed.dart", ".g.cs", ".g.dart", ".pb.go", ".pb.gw.go", "_pb2.py", "_pb2_grpc.py")
MARKER_LINES = 40
MARKERS = ("@generated", "<auto-generated", "code generated by", "do not edit", "do not modify this file", "generated by")
MOST_BYTES = 1 << 20
MINIFIED_MEAN, MINIFIED_LONGEST = 110, 1000
TEST_FOLDERS = ("__tests__", "spec", "test", "tests")
SIGNED_LEAST, SIGNED_COVERAGE, SIGNED_SHARE = 50, 0.25, 0.6


def scan(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path (below root), size, modified, content, for files of at most a MiB outside pruned folders; path and size filters come before any reading of content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    path = F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    files = raw.filter(F.col("length") <= MOST_BYTES).select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("content").cast("string").alias("content"))
    return files.filter(~F.arrays_overlap(segments(F.col("path")), F.array(*map(F.lit, PRUNED))))


def language(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, exts in LANGUAGES.items():
        out = F.when(extension(path).isin(*exts), F.lit(name)).otherwise(out)
    return out


def exclusion(path: Column, content: Column) -> Column:
    """Why a file is left out: generated-name, generated-marker, minified, test, or null."""
    lines = F.split(content, "\n")
    head = F.slice(lines, 1, MARKER_LINES)
    name = F.lit(False)
    for s in GENERATED_SUFFIXES:
        name = name | path.endswith(s)
    marks = "(?i)^[^A-Za-z0-9@<]*(" + "|".join(MARKERS) + ")"
    sizes = F.transform(lines, F.length)
    mean = F.aggregate(sizes, F.lit(0), lambda a, x: a + x) / F.size(sizes)
    return (
        F.when(name, F.lit("generated-name"))
        .when(F.exists(head, lambda x: x.rlike(marks)), F.lit("generated-marker"))
        .when((mean > MINIFIED_MEAN) & (F.array_max(sizes) >= MINIFIED_LONGEST), F.lit("minified"))
        .when(F.arrays_overlap(F.transform(segments(path), F.lower), F.array(*map(F.lit, TEST_FOLDERS))) | basename(path).rlike(r"(_test|_spec|\.test|\.spec)\.[^.]+$|^test_.*\.py$"), F.lit("test"))
    )


def foreign(files: DataFrame) -> DataFrame:
    """Paths whose copyright line differs from the dominant one, if enough files carry a line and one dominates."""
    sig = F.lower(F.trim(F.regexp_replace(F.regexp_extract("content", r"(?i)copyright\s+(?:\(c\)\s*)?[\d,\- ]*(.{3,60})", 1), r"[\s*/#]+$", "")))
    s = files.select("path", sig.alias("sig"))
    n = s.agg(F.count("*").alias("all"), F.sum((F.col("sig") != "").cast("int")).alias("signed"))
    top = s.filter("sig <> ''").groupBy("sig").agg(F.count("*").alias("c")).agg(F.max_by("sig", F.struct("c", "sig")).alias("main"), F.max("c").alias("c"))
    gate = n.join(top, F.lit(True)).filter((F.col("signed") >= SIGNED_LEAST) & (F.col("signed") / F.col("all") >= SIGNED_COVERAGE) & (F.col("c") / F.col("signed") >= SIGNED_SHARE))  # one row each
    return s.filter("sig <> ''").join(F.broadcast(gate), F.lit(True)).filter("sig <> main").select("path", F.lit("vendored").alias("reason"))


def classify(files: DataFrame) -> DataFrame:
    """Adds language, excluded (reason or null) and content_hash."""
    f = files.withColumns({"language": language(F.col("path")), "excluded": exclusion(F.col("path"), F.col("content")), "content_hash": F.sha2(F.col("content").cast("binary"), 256)})
    v = foreign(files).withColumnRenamed("reason", "_v")
    return f.join(v, "path", "left").withColumn("excluded", F.coalesce("excluded", "_v")).drop("_v")


def scripts_of(content: Column) -> Column:
    """The script part of a single-file component."""
    return F.regexp_extract(content, r"(?s)<script[^>]*>(.*?)</script>", 1)


def tree_signature(files: DataFrame) -> DataFrame:
    """One row: a hash of all paths and content hashes, combined over 4096 buckets."""
    parts = files.groupBy(F.pmod(F.crc32(F.col("path").cast("binary")), F.lit(4096)).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "path", "content_hash"))), "\n").cast("binary"), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n").cast("binary"), 256).alias("signature"))


def exclusions_by_reason(classified: DataFrame) -> DataFrame:
    return classified.groupBy(F.coalesce("excluded", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def features_folders(paths: DataFrame) -> DataFrame:
    """Files below a ``features`` folder that holds .feature files itself."""
    own = paths.filter(F.col("path").endswith(".feature")).select(F.regexp_extract("path", r"^(.*?features)/[^/]*$", 1).alias("folder")).filter("folder <> ''").distinct()
    p = paths.select("path", F.regexp_extract("path", r"^(.*?features)/", 1).alias("folder")).filter("folder <> ''")
    return p.join(own, "folder", "left_semi").select("path", F.lit("test").alias("reason"))


