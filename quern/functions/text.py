"""Tokens, names in context and suspicious expressions of source text, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern import dims

#: Suffix of a path as splitext has it: leading dots belong to the name.
SUFFIX = r"(?s)(?:^|/)\.*[^./][^/]*(\.[^./]*)\z"
#: Fixed values, needed for equal results: what is stripped in this order, identifiers, and the expressions of names in context below.
STRIPPED = [r"(?s)/\*.*?\*/", r"(?md)//.*?$", r"(?md)#.*?$", r'"[^"]*"', r"'[^']*'"]
IDENT = r"[a-zA-Z_][a-zA-Z0-9_]*"
WHOLE = r"(?<![\p{L}\p{N}_])" + IDENT + r"(?![\p{L}\p{N}_])"


def suffix(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(path, SUFFIX, 1))


def basename(path: str | Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1))


def safe_name(path: Column) -> Column:
    """A path as a name inside a container: separators, dots and blanks replaced."""
    return F.replace(F.replace(F.replace(F.replace(path, F.lit("/"), F.lit("_")), F.lit("\\"), F.lit("_")), F.lit("."), F.lit("_dot_")), F.lit(" "), F.lit("_"))


def stripped(c: Column) -> Column:
    """Without comments and strings, taken off in this order."""
    for p in STRIPPED:
        c = F.regexp_replace(c, p, "")
    return c


def words(c: Column) -> Column:
    """Identifiers of lower-cased text, repeats kept."""
    return F.regexp_extract_all(F.lower(c), F.lit(WHOLE), F.lit(0))


def tokens(c: Column) -> Column:
    """Identifiers of at least three characters outside comments and strings, no stop words; repeats kept."""
    stop = F.array(*map(F.lit, dims.STOP_WORDS))
    return F.filter(words(stripped(c)), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))


def function_names(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(rf"(?i)(?:def|function|func|fn)\s+({IDENT})"), F.lit(1)))


def class_names(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(rf"(?i)class\s+({IDENT})"), F.lit(1)))


def import_names(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?i)(?:import|from|require|include)\s+([a-zA-Z_][a-zA-Z0-9_.]*)"), F.lit(1)))


def comment_words(c: Column) -> Column:
    comments = F.regexp_extract_all(c, F.lit(r"(?md)(?://|#)\s*(.+?)$"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(comments, words)))


def literal_of(expression: str) -> str:
    """The longest run of word characters that a match of one of the suspicious expressions must hold, in lower case."""
    return max(re.findall(r"\w+", re.sub(r"\\[sb][*+]?|\\.|\.\*", " ", expression)), key=len).lower()


def suspicious(c: Column) -> Column:
    """Distinct matched strings of the suspicious expressions, sorted. An expression is tried only where its literal stands in the lowered text."""
    none = F.array().cast("array<string>")
    each = lambda low: F.array(*[F.when(F.contains(low, F.lit(literal_of(p))), F.regexp_extract_all(c, F.lit("(?id)" + p), F.lit(0))).otherwise(none) for p in dims.PATTERNS])
    found = F.transform(F.array(F.lower(c)), lambda low: F.flatten(each(low)))
    return F.array_sort(F.array_distinct(F.coalesce(F.element_at(found, 1), none)))
