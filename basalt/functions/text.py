"""Column functions on paths, identifiers and source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of programming languages, and words too common in code, that tell nothing of a symbol.
STOP_WORDS = (
    "const let var function return this self def class public private protected static void string number boolean "
    "any null undefined true false none nil new await async import export from require module end else elif then "
    "while for each case switch break continue try catch finally throw raise yield type interface extends implements "
    "readonly unknown never object array map set get has err error value values item items data result args opts"
).split(" ")


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.[^./]+$", 0)


def common_prefix_length(a: Column, b: Column) -> Column:
    """Number of leading segments that two arrays share."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: ~F.coalesce(F.get(a, i - 1) == F.get(b, i - 1), F.lit(False)))
    return F.when(n == 0, F.lit(0)).otherwise(F.coalesce(F.get(differ, F.lit(0)) - 1, n))


def path_distance(a: Column, b: Column) -> Column:
    """Folder steps from one file to another."""
    x, y = segments(dirname(a)), segments(dirname(b))
    return F.size(x) + F.size(y) - 2 * common_prefix_length(x, y)


def folder_prefixes(path: Column) -> Column:
    """All folders that a file is in, outermost first, as whole paths; for ``prefix_distance``."""
    s = segments(dirname(path))
    return F.transform(s, lambda x, i: F.array_join(F.slice(s, 1, i + 1), "/"))


def prefix_distance(a: Column, b: Column) -> Column:
    """``path_distance`` of two files from their ``folder_prefixes``, which need computing only once for each file."""
    return F.size(a) + F.size(b) - 2 * F.size(F.array_intersect(a, b))


def suffixes(path: Column) -> Column:
    """All suffixes of a path, longest first."""
    s = segments(path)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1))), lambda i: F.array_join(F.slice(s, i, F.greatest(F.size(s), F.lit(1))), "/"))


def identifier_words(name: Column) -> Column:
    """camelCase and snake_case parts in lower case, of three characters at least, as often as they occur, without stop words."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.split(F.lower(F.regexp_replace(spaced, "[^A-Za-z0-9]+", " ")), " +")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))


def normalized_source(text: Column) -> Column:
    """Source without comments and with single spaces."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), r"(?m)(//|#).*$", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))
