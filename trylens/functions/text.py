"""Text cleaning and field extraction as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .java import CATCH_PATTERN, PY_SPACE_CLASS, PY_SPACES

_WS = PY_SPACE_CLASS
# A run without white space; one range test for most of its characters, no recursion.
_TOKEN = rf"[!-~]++[^{_WS[1:]}*+|[^{_WS[1:]}++"


def py_strip(c: Column) -> Column:
    """``str.strip()``: remove Python whitespace at both ends."""
    return F.btrim(c, F.lit(PY_SPACES))


def py_lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(PY_SPACES))


def py_split(c: Column) -> Column:
    """``str.split()`` with no separator: whitespace runs, no empty tokens."""
    return F.regexp_extract_all(c, F.lit(_TOKEN), 0)


def normalize_code_whitespace(c: Column) -> Column:
    """Drop whitespace around ``(``, ``)``, ``.``; ``\\r``/``\\t`` -> space."""
    squeezed = F.regexp_replace(c, f"{_WS}*([().]){_WS}*", "$1")
    return F.replace(F.replace(squeezed, F.lit("\r"), F.lit(" ")), F.lit("\t"), F.lit(" "))


def clean_method_source(c: Column) -> Column:
    """Strip; drop a non-word prefix through the first word; backslash fixes."""
    s = py_strip(c)
    s = F.when(s.rlike(r"^\w"), s).otherwise(
        F.regexp_replace(s, r"^[^\n]*?(\w+)", " $1"))
    s = F.regexp_replace(s, r"\\\\", " ")
    return F.regexp_replace(s, r'\\ "', r' \\"')


def rename_declared_variables(line: Column) -> Column:
    """``Type name = ...`` / ``Type name ;`` -> name := type with a lower first letter.

    Only the declaring line changes.  Runs of 4, 3, then 2 spaces are each
    collapsed once, left to right, before splitting on single spaces.
    """
    t = py_lstrip(line)
    for run in ("    ", "   ", "  "):
        t = F.replace(t, F.lit(run), F.lit(" "))

    def body(tt):
        def with_words(words):
            hit = (F.size(words) > 2) & F.coalesce(F.try_element_at(words, F.lit(3)).isin("=", ";"), F.lit(False))
            w0 = words[0]
            renamed = F.concat(F.lower(F.substring(w0, 1, 1)), F.substring(w0, 2, 1 << 30))
            new_words = F.transform(words, lambda w, i: F.when(i == 1, renamed).otherwise(w))
            return F.when(hit, F.array_join(new_words, " ")).otherwise(tt)
        return let(F.split(py_lstrip(tt), " ", -1), with_words)
    return let(t, body)


def wrap_full_method(src: Column, tgt: Column, tgt_newline: bool = True) -> Column:
    """Source + target + ``" }"``.  Text-file targets keep their newline."""
    parts = [src, tgt] + ([F.lit("\n")] if tgt_newline else []) + [F.lit(" }")]
    return F.concat(*parts)


def extract_exception_types(tgt: Column, unicode: bool = False) -> Column:
    """Types of the first matching catch clause, ``', '``-joined; else ``Exception``.

    Group 1 of the pattern admits no whitespace, so the per-type strip of the
    union parts is already satisfied.
    """
    pattern = ("(?U)" if unicode else "") + CATCH_PATTERN
    group = F.regexp_extract(tgt, pattern, 1)
    joined = F.array_join(F.split(group, r"\|"), ", ")
    return F.when(group == "", F.lit("Exception")).otherwise(joined)


def resplit_tokens(tokens: Column) -> Column:
    """A token longer than 2 characters becomes its ``\\w+`` / ``.`` pieces.

    A token made only of ASCII word characters is its own single piece, so
    it skips the second regex.
    """
    def one(t):
        return F.when((F.length(t) > 2) & t.rlike("[^0-9A-Za-z_]"), F.regexp_extract_all(t, F.lit(r"(\w+|[.])"), 1)) \
                .otherwise(F.array(t))
    return F.flatten(F.transform(tokens, one))


def cut_chars(c: Column, max_len: int) -> Column:
    """P10: keep the first ``max_len - 2`` characters (before tokenising)."""
    return F.substring(c, 1, max_len - 2)
