"""Text functions on columns; all but ``similarity`` run in the JVM."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normalize_spaces(c: Column) -> Column:
    """White space runs to one space, trimmed; null to ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def normalize_label(c: Column) -> Column:
    """Spaces normalized, typographic quotes made plain."""
    return F.translate(normalize_spaces(c), "’“”", "'\"\"")


def canonical_label(c: Column) -> Column:
    """Without a trailing parenthesis and without double quotes."""
    return normalize_spaces(F.regexp_replace(F.regexp_replace(normalize_label(c), r"\s*\([^)]*\)\s*$", ""), '"', ""))


def ascii_key(c: Column) -> Column:
    """Lower-cased canonical label of letters, digits, spaces, apostrophes and hyphens."""
    return normalize_spaces(F.regexp_replace(F.lower(canonical_label(c)), r"[^a-z0-9\s'-]+", " "))


def match_key(c: Column) -> Column:
    """The form in which labels and questions are compared."""
    low = F.translate(F.lower(F.trim(F.coalesce(c, F.lit("")))), "’", "'")
    return normalize_spaces(F.regexp_replace(low, r"[^a-z0-9\s'_:-]", " "))


def local_name(uri: Column) -> Column:
    """What follows the first '#', else the last '/'."""
    return F.when(F.instr(uri, "#") > 0, F.regexp_extract(uri, "^[^#]*#(.*)$", 1)).otherwise(F.regexp_extract(uri, "([^/]*)$", 1))


def slug(c: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out == "", "unknown").otherwise(out)


def entity_id(entity_class: Column, text: Column) -> Column:
    """CLASS:slug-h6, h6 the beginning of sha1('CLASS:text')."""
    return F.concat(entity_class, F.lit(":"), slug(text), F.lit("-"), F.substring(F.sha1(F.concat(entity_class, F.lit(":"), text)), 1, 6))


def token_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_key(c), F.lit("[a-z0-9]+"), F.lit(0)))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger token set; 0 if one is empty."""
    x, y = token_set(a), token_set(b)
    most = F.greatest(F.size(x), F.size(y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / most)


def name_tokens(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(normalize_label(c), F.lit("[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?"), F.lit(0)), F.lower)


def sentences(c: Column) -> Column:
    """Split behind '.', '!' and '?' that white space follows."""
    parts = F.split(normalize_spaces(c), r"(?<=[.!?])\s+")
    return F.filter(parts, lambda s: s != "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(normalize_spaces(c), " "), lambda w: w != ""))


def contains_any(c: Column, patterns: list[str]) -> Column:
    """Whether the lower-cased text holds one of the (few, literal) patterns."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(p.lower()))
    return out


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks (Ratcliff and Obershelp); no built-in function computes it."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])
