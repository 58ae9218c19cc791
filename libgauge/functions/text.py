"""Text functions, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .distance import as_similarity, banded

#: White space at either end, including the separators U+001C to U+001F.
OUTER_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, OUTER_SPACE, "")


def similarity(left: Column, right: Column) -> Column:
    """1 - edit distance / longer length, in code points; 1 for two empty strings.  One expression for texts that
    are short or alike: bands first, then Spark's whole matrix.  ``operators.measure`` is for large tables."""
    return as_similarity(F.coalesce(banded(left, right), F.levenshtein(left, right)), left, right)


def safe_filename(x: Column) -> Column:
    """Runs of other characters than A-Z a-z 0-9 . _ - become one dash; dashes at the ends go."""
    dashed = F.btrim(F.regexp_replace(strip(x), "[^A-Za-z0-9._-]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(dashed, F.lit("")), F.lit("protocol"))


def path_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def path_suffix(path: Column) -> Column:
    """The last dot and what follows; none for a leading or a final dot."""
    return F.regexp_extract(path_name(path), r"[^.].*?(\.[^.]+)$|^[^.](\.[^.]+)$", 1)


def path_stem(path: Column) -> Column:
    name = path_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(path_suffix(path)))


def newline_count(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))


def filled(x: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(x, F.lit(""))
