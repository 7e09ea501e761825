"""Real Java source without a parser: A1, A5-A8, A11, A14, A15 and F2 on lexer
tokens and the statement tree.

The operators of ``structure`` and ``slicing`` take text whose tokens are set
apart by white space; these take source as it is written.  All of them are
projections of one row; nothing is shuffled.  ``parsed``, ``tag_source_lines`` and
``source_marker_stream`` take the name of a column (``built_once``).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import built_once, let
from ..functions.expressions import marker_stream
from ..functions.folds import brace_depth, last_marker_index, segment_statements
from ..functions.lexer import code_of_pieces, code_words, pieces
from ..functions.text import normalize_code_whitespace, py_split
from ..functions.tree import Sources, list_of, parse, statement_kind, walk

# Scopes that are a block of their own, at their brace.
_BLOCKS = ("if", "for", "while", "else", "do", "block")
_TYPES = {"class": "ClassDeclaration", "interface": "InterfaceDeclaration", "enum": "EnumDeclaration",
          "record": "RecordDeclaration"}


def source_depth(src: Column) -> Column:
    """Open minus close braces of the code; those in literals and comments do not count."""
    return brace_depth(code_words(src))


def repair_unclosed_source(src: Column) -> Column:
    """A5: struct(depth, parse_ok, code): up to two missing braces are added, any
    other text falls back to its normalised form and three braces."""
    return let(src, lambda f: let(source_depth(f), lambda d: _repaired(f, d)))


def _repaired(f: Column, d: Column) -> Column:
    ok = (d >= 0) & (d <= 2)
    # on a line of its own: a comment may end the text
    repaired = F.concat(f, F.when(d > 0, F.concat(F.lit("\n"), F.array_join(F.array_repeat(F.lit("}"), d), " "))).otherwise(F.lit("")))
    return F.struct(d.alias("depth"), ok.alias("parse_ok"),
                    F.when(ok, repaired).otherwise(F.concat(normalize_code_whitespace(f), F.lit(" } } }"))).alias("code"))


@built_once
def source_marker_stream(src: Column) -> Column:
    """A4 with expression markers: struct(parse_ok, tokens) of the repaired
    source; what cannot be repaired is split on white space (A5)."""
    # what is walked stands outside of lambdas
    code = code_of_pieces(pieces(src))
    r = _repaired(src, code["depth"])
    # only what is repaired is cut into pieces again
    stream = marker_stream(F.when(r["depth"] == 0, code["words"]).when(r["parse_ok"], code_words(r["code"])))
    return F.struct(r["parse_ok"].alias("parse_ok"), F.when(r["parse_ok"], stream).otherwise(py_split(r["code"])).alias("tokens"))


def source_markers(src: Column) -> Column:
    """struct(n_words, try_idx, catch_idx) in code words; -1 if none."""
    return let(code_words(src), lambda w: F.struct(
        F.size(w).alias("n_words"), last_marker_index(w, "try").alias("try_idx"),
        last_marker_index(w, "catch").alias("catch_idx")))


def source_statements(src: Column) -> Column:
    """A11 on code words: flat statement intervals."""
    return let(code_words(src), segment_statements)


def split_parsed_sources(df: DataFrame, src: str = "src") -> tuple[DataFrame, DataFrame]:
    """F2 as a split: (balanced sources, others with ``reason``)."""
    # text and depth are bound: the filters below move into the scan of the
    # source and would work them out once for every place that reads them
    reason = let(F.col(src), lambda f: F.when(f.isNull() | (F.trim(f) == ""), "empty").otherwise(
        let(source_depth(f), lambda n: F.when(n > 0, "unclosed braces").when(n < 0, "closing braces without an opening one"))))
    d = df.withColumn("reason", reason)
    return d.where("reason is null").drop("reason"), d.where("reason is not null")


parsed = built_once(parse)


# the tag of a scope of each kind that stands on a line
_SCOPE_TAGS = {**dict.fromkeys(_BLOCKS, "BlockStatement"), "catch": "CatchClause", "method": "MethodDeclaration", **_TYPES}


@F.arrow_udf(T.ArrayType(T.StringType()))
def _line_tags(p: pa.Array, n_lines: pa.Array) -> pa.Array:
    x = Sources(p)
    out = []
    for (lo, t, stops), n in zip(x.rows(), n_lines.to_pylist()):
        if n is None:
            out.append(None)
            continue
        line = x.line[lo:lo + len(t)].tolist()
        last: dict[int, tuple] = {}              # per line the last mark by place, level and tag
        for role, kind, start, opened, _, level, *_ in walk(t, stops):
            if role != "scope":
                at, tag = start, None if role == "member" else kind or statement_kind(t, start)
            else:
                at, tag = opened if kind in _BLOCKS else start, _SCOPE_TAGS.get(kind)
            if tag is not None:
                mark = (at, level, tag)
                if mark >= last.get(line[at], mark):
                    last[line[at]] = mark
        tags = [last[k][2] if k in last else None for k in range(1, n + 1)]
        if n:
            tags[-1] = "MethodDeclaration END"
        out.append(tags)
    return pa.array(out, pa.list_(pa.string()))


@built_once
def tag_source_lines(lines: Column) -> Column:
    """A1 by the tree: per line of a method the kind of the deepest node that
    begins on it, null for a line that goes on with an earlier one; the last
    line is ``MethodDeclaration END``."""
    return _line_tags(pieces(F.array_join(lines, "\n")), F.size(lines))


_METHOD = T.StructType([T.StructField("name", T.StringType()), T.StructField("has_body", T.BooleanType()),
                        T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()),
                        T.StructField("text", T.StringType())])
_STATEMENT = T.StructType([T.StructField("kind", T.StringType()), *_METHOD.fields[2:]])
_METHOD_ROLES, _BODY_ROLES = frozenset(("scope", "member")), frozenset(("scope", "statement"))


def _method_name(t: list[str], start: int, stop: int) -> str | None:
    """The first name before a parenthesis of the head that is no annotation's."""
    for k in range(start + 1, stop):
        if t[k] == "(" and (t[k - 1][0] in "_$" or t[k - 1][0].isalpha()) and not (k - 1 > start and t[k - 2] in ("@", ".")):
            return t[k - 1]
    return None


@F.arrow_udf(T.ArrayType(_METHOD))
def _methods(p: pa.Array) -> pa.Array:
    x = Sources(p)
    sizes, names, bodies, first, last = [], [], [], [], []
    for lo, t, stops in x.rows():
        own = [n for n in walk(t, stops, _METHOD_ROLES) if n[1] == "method"]
        sizes.append(len(own))
        for _, _, start, opened, end, *_ in own:
            names.append(_method_name(t, start, end if opened is None else opened))
            bodies.append(opened is not None)
            first.append(lo + start)
            last.append(lo + (len(t) - 1 if end is None else end))
    return list_of(sizes, [pa.array(names, pa.string()), pa.array(bodies, pa.bool_()), *x.spans(first, last)], _METHOD)


@F.arrow_udf(T.ArrayType(_STATEMENT))
def _body_statements(p: pa.Array) -> pa.Array:
    x = Sources(p)
    sizes, kinds, first, last = [], [], [], []
    for lo, t, stops in x.rows():
        found = walk(t, stops, _BODY_ROLES)
        body = next((n[3] for n in found if n[0] == "scope" and n[1] == "method"), None)
        own = [n for n in found if n[0] == "statement" and n[6] == body]
        sizes.append(len(own))
        for _, kind, start, _, end, *_ in own:
            kinds.append(kind or statement_kind(t, start))
            first.append(lo + start)
            last.append(lo + (len(t) - 1 if end is None else end))
    return list_of(sizes, [pa.array(kinds, pa.string()), *x.spans(first, last)], _STATEMENT)


def _of_pieces(step, src: Column) -> Column:
    """``step`` of the pieces of ``src``; null for a null text.

    ``src`` is read twice: the optimizer would move what is read once into an
    aggregation below it, and Spark does not take a Python step out of there."""
    return F.when(F.length(src) >= 0, step(pieces(src)))


def _exploded(found: DataFrame, keep: list[str], number: str) -> DataFrame:
    """``keep``, ``number`` and ``_m`` for every element of ``_f``.

    An inner explode infers a filter on its input, for which the array would be
    computed a second time."""
    return found.select(*keep, F.posexplode_outer("_f").alias(number, "_m")).where(F.col(number).isNotNull())


def extract_nested_methods(files: DataFrame, file_col: str = "file_id", src: str = "src") -> DataFrame:
    """One row per method of a file, in inner, local, anonymous, enum and
    record types too: method_no, name, has_body, start_line, end_line, n_lines, text.

    A method that the text leaves open ends with the text."""
    x = _exploded(files.select(file_col, _of_pieces(_methods, F.col(src)).alias("_f")), [file_col], "_i")
    return x.select(file_col, (F.col("_i") + 1).cast("long").alias("method_no"), "_m.*") \
            .withColumn("n_lines", (F.col("end_line") - F.col("start_line") + 1).cast("long"))


def explode_body_statements(methods: DataFrame, keep: tuple[str, ...], src: str = "src") -> DataFrame:
    """One row per statement directly in the body of the row's first method:
    stmt_no, kind, start_line, end_line, text; code before, in and after a try."""
    x = _exploded(methods.select(*keep, _of_pieces(_body_statements, F.col(src)).alias("_f")), list(keep), "stmt_no")
    return x.select(*keep, "stmt_no", "_m.kind", "_m.start_line", "_m.end_line", "_m.text")
