"""Line structure of methods without a Java parser.

A method is one row with ordered ``lines`` / ``labels`` arrays, so tagging,
merging and appending are array transforms inside a row: no shuffle, no
window.  Only A14 (methods inside a file) needs a window, partitioned by file.

The line-kind rules (A1) and the structural token rules (A4) are our own
equal a full parser's output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.folds import brace_depth
from ..functions.streams import (depth_of_text, front_back, marker_stream, marker_words, model_words, read_lines,
                                 read_method_text, stream_column, words_column)
from ..functions.text import normalize_code_whitespace, py_split, py_strip

# Line-kind rules (ours), applied to the stripped line without leading '}'
# tokens; first match wins, after "last line" and "first line".  ``word``
# rules test the line's first word (its leading \w+ run); ``word{`` also
# needs the line to end with '{'; ``regex`` and ``contains`` test the line.
LINE_KIND_RULES = (
    ("word", ("try",), "TryStatement"),
    ("word", ("catch",), "CatchClause"),
    ("word{", ("if", "for", "while", "do", "else"), "BlockStatement"),
    ("word", ("if",), "IfStatement"),
    ("word", ("for",), "ForStatement"),
    ("word", ("while",), "WhileStatement"),
    ("word", ("do",), "DoStatement"),
    ("word", ("switch",), "SwitchStatement"),
    ("word", ("case", "default"), "SwitchStatementCase"),
    ("word", ("return",), "ReturnStatement"),
    ("word", ("throw",), "ThrowStatement"),
    ("word", ("break",), "BreakStatement"),
    ("word", ("continue",), "ContinueStatement"),
    ("word", ("synchronized",), "SynchronizedStatement"),
    ("regex", r"^(final\s+)?[A-Za-z_][\w.]*(\s*<[^=;]*>)?(\s*\[\s*\])*\s+[A-Za-z_]\w*\s*(=|;|,)",
     "LocalVariableDeclaration"),
    ("regex", r"(^|[^=!<>])=($|[^=])", "Assignment"),
    ("contains", "(", "MethodInvocation"),
)


MAX_RULES = 1000        # rules are data of bounded size, checked before they are collected


def rules_frame(spark: SparkSession, rules=LINE_KIND_RULES) -> DataFrame:
    """Line-kind rules as a table: priority, kind, args, tag."""
    rows = [(i, kind, list(arg) if isinstance(arg, tuple) else [arg], tag) for i, (kind, arg, tag) in enumerate(rules)]
    return spark.createDataFrame(rows, "priority int, kind string, args array<string>, tag string")


def rules_from(frame: DataFrame) -> tuple:
    """A table of rules (see ``rules_frame``) as ``line_kind`` takes them, first
    match by priority; at most ``MAX_RULES``."""
    rows = frame.select("priority", "kind", "args", "tag").orderBy("priority", "kind", "tag").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} line-kind rules")
    unknown = {r["kind"] for r in rows} - {"word", "word{", "regex", "contains"}
    if unknown:
        raise ValueError(f"unknown rule kinds: {sorted(map(str, unknown))}")
    return tuple((r["kind"], tuple(r["args"]) if r["kind"].startswith("word") else r["args"][0], r["tag"]) for r in rows)


def line_kind(line: Column, idx: Column, n_lines: Column, rules=LINE_KIND_RULES) -> Column:
    """A1: node kind of line ``idx`` (0-based) of an ``n_lines``-line method, or null.

    One regex extracts the first word; keyword rules are set tests on it, so
    most lines need no further regex."""
    def body(sw):
        s, w = sw["s"], sw["w"]
        out = F.when(idx == n_lines - 1, F.lit("MethodDeclaration END")) \
               .when(idx == 0, F.lit("MethodDeclaration"))
        for kind, arg, tag in rules:
            if kind == "word":
                test = w.isin(*arg)
            elif kind == "word{":
                test = w.isin(*arg) & s.endswith("{")
            elif kind == "regex":
                test = s.rlike(arg)
            else:
                test = s.contains(arg)
            out = out.when(test, F.lit(tag))
        return out
    stripped = py_strip(F.regexp_replace(py_strip(line), r"^(\}\s*)+", ""))
    return let(stripped, lambda s: let(F.struct(s.alias("s"), F.regexp_extract(s, r"^(\w+)", 1).alias("w")), body))


def tag_lines(lines: Column, rules=LINE_KIND_RULES) -> Column:
    """A1 over a method: one tag (or null) per line."""
    return let(lines, lambda ls: F.transform(ls, lambda ln, i: line_kind(ln, i, F.size(ls), rules)))


# A1 + A3 + P3 on a method's lines, as words per line, and (L3) with those of both
# neighbours: as a column, and as readers for the line models.
line_words_in_context = words_column(model_words(LINE_KIND_RULES, True))
read_line_words = read_lines(model_words(LINE_KIND_RULES, False))
read_line_words_in_context = read_lines(model_words(LINE_KIND_RULES, True))


def merge_statement_lines(lines: Column, labels: Column, tags: Column) -> Column:
    """A2: array<struct<text, label>>, one entry per tagged line.

    A group runs from a tagged line to the next tagged line; its text is the
    raw lines concatenated with no separator, then the tag appended; its label
    is the label of its first line.  Lines before the first tag are dropped.
    """
    def body(tg, ls, lb):
        starts = F.filter(F.transform(tg, lambda t, i: F.when(t.isNotNull(), i)), lambda i: i.isNotNull())

        def group(st, s, k):
            nxt = F.coalesce(F.try_element_at(st, k + 2), F.size(tg))
            text = F.concat(F.array_join(F.slice(ls, s + 1, nxt - s), ""), F.element_at(tg, s + 1))
            return F.struct(text.alias("text"), F.element_at(lb, s + 1).alias("label"))

        return let(starts, lambda st: F.transform(st, lambda s, k: group(st, s, k)))
    # what a group reads is bound outside it, or it would be taken again for every group
    return let(tags, lambda tg: let(lines, lambda ls: let(labels, lambda lb: body(tg, ls, lb))))


def append_line_tags(lines: Column, tags: Column) -> Column:
    """A3: every line kept, its tag appended when it has one."""
    return let(tags, lambda tg: F.transform(
        lines, lambda ln, i: F.concat(ln, F.coalesce(F.element_at(tg, i + 1), F.lit("")))))


def method_is_balanced(src: Column) -> Column:
    """F2 parse check for a lone method: braces outside quotes balance."""
    return depth_of_text(src) == 0


def repair_unclosed_method(func: Column, tokens: bool = True) -> Column:
    """A5: struct(depth, parse_ok, code) and, unless switched off, the A4 ``tokens``.

    depth = open minus close braces outside quotes.  0-2 -> append that many
    ``" }"`` and parse; otherwise fall back to the whitespace split of the
    normalised text with three braces added (``parse_ok`` false).
    """
    d = depth_of_text(func)
    ok = (d >= 0) & (d <= 2)
    repaired = F.concat(func, F.repeat(F.lit(" }"), F.greatest(d, F.lit(0))))
    fallback = F.concat(normalize_code_whitespace(func), F.lit(" } } }"))
    out = [d.alias("depth"), ok.alias("parse_ok"), F.when(ok, repaired).otherwise(fallback).alias("code")]
    if tokens:
        stream = structural_token_stream(F.when(ok, repaired))
        out.append(F.when(ok, stream).otherwise(py_split(fallback)).alias("tokens"))
    return F.struct(*out)


# Structural markers (A4): keyword -> marker.
STRUCT_KEYWORDS = {"try": "TRY", "catch": "CatchClause", "return": "RETURN", "else": "ELSE",
                   "throws": "throws"}
_CONTROL = ("if", "for", "while", "switch", "catch", "synchronized", "return", "new", "throw")
_TOKEN_RE = r'"[^"]*"|\w+|[{}()\[\];,.=]|[^\s\w"{}()\[\];,.=]+'


def structural_token_stream(code: Column) -> Column:
    """A4: method text -> flat marker stream, then P9 re-splitting.

    Rules: keywords of STRUCT_KEYWORDS become markers; ``name (`` becomes
    ``METHOD INVOCATION name arguments`` (the ``( ... )`` follows); ``q .`` becomes ``qualifier q`` (the dot is
    dropped); a declaration ``Type name`` becomes ``VarDec Type``; ``=`` after
    a declared name becomes ``initializer``; string literals lose their quotes
    and are split on spaces; brackets and other tokens are kept.
    """
    return _stream_column(F.regexp_extract_all(code, F.lit(_TOKEN_RE), 0))


_marker_stream = marker_stream(STRUCT_KEYWORDS, _CONTROL)
_stream_column = stream_column(_marker_stream)
# A5 + A4 + A7, A8, A10 as a reader for the type models
read_repaired_method = read_method_text(_marker_stream, _TOKEN_RE)


def marker_tokens(src: Column, tgt: Column) -> Column:
    """Marker stream for A7/A8/A10: source tokens with ``try`` -> ``TRY`` and
    target tokens with ``catch`` -> ``CatchClause``."""
    return marker_words(src, tgt)


def split_front_back_at_catch(tokens: Column) -> Column:
    """A7 + A8 + A10: struct(try_idx, catch_idx, front, back).

    front = tokens[:try], back = tokens[try:catch], Python slice rules (so
    both -1 gives all-but-last and an empty back).
    """
    return front_back(tokens)


def extract_methods(file_lines: DataFrame, file_col: str = "file_id", line_no: str = "line_no",
                    line: str = "line") -> DataFrame:
    """One row per method of a file: method_no, start_line, end_line, n_lines.

    The brace depth is a running sum of per-line net braces (outside quotes)
    per file in line order (``running_sum``: skew-safe two-level prefix sum);
    a line that opens at class depth 1 starts a method, which runs until the
    depth is back to 1.
    """
    from .util import running_sum
    x = file_lines.withColumn("_net", brace_depth(py_split(F.col(line))))
    x = running_sum(x, file_col, line_no, "_net", "_after")
    x = x.withColumn("_before", F.col("_after") - F.col("_net"))
    start = (F.col("_before") == 1) & (F.col("_net") > 0)
    x = running_sum(x, file_col, line_no, start.cast("int"), "method_no")
    inside = (F.col("method_no") > 0) & ((F.col("_before") >= 2) | start)
    return x.where(inside).groupBy(file_col, "method_no").agg(
        F.min(line_no).alias("start_line"), F.max(line_no).alias("end_line"),
        F.count("*").alias("n_lines"))


def extract_methods_from_files(files: DataFrame, file_col: str = "file_id", lines: str = "lines") -> DataFrame:
    """A14 for files held as one row of ordered lines: the rules of
    ``extract_methods``, folded inside the row (no shuffle).

    The fold carries the depth, the method being read and those closed; a method
    without a further line at depth 2 or more ends on its first line.
    """
    span = "struct<start_line:int,end_line:int,n_lines:bigint>"
    init = F.struct(F.lit(0).alias("d"), F.lit(0).alias("i"), F.lit(None).cast(span).alias("cur"),
                    F.array().cast(f"array<{span}>").alias("done"))

    def closed(acc):
        return F.when(acc["cur"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"])))

    def step(acc, net):
        i = acc["i"] + 1
        start = (acc["d"] == 1) & (net > 0)
        cur = acc["cur"]
        first = F.struct(i.alias("start_line"), i.alias("end_line"), F.lit(1).cast("long").alias("n_lines"))
        more = F.struct(cur["start_line"].alias("start_line"), i.alias("end_line"),
                        (cur["n_lines"] + 1).alias("n_lines"))
        return F.struct((acc["d"] + net).alias("d"), i.alias("i"),
                        F.when(start, first).when(cur.isNotNull() & (acc["d"] >= 2), more).otherwise(cur)
                         .cast(span).alias("cur"),
                        F.when(start, closed(acc)).otherwise(acc["done"]).alias("done"))

    nets = F.transform(lines, lambda ln: brace_depth(py_split(ln)))
    spans = let(nets, lambda ns: F.aggregate(ns, init, step, closed))
    x = files.select(file_col, F.posexplode(spans).alias("k", "m"))
    return x.select(file_col, (F.col("k") + 1).cast("long").alias("method_no"), "m.start_line", "m.end_line", "m.n_lines")


def split_parsed(methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F2 as a split: (kept, quarantined with ``reason``).

    The reference silently skips a method whose parse fails or that merges to
    no lines; here such methods go to a quarantine frame instead."""
    ok = method_is_balanced(F.col("src"))
    n = F.size(merge_statement_lines(F.col("lines"), F.col("labels"), tag_lines(F.col("lines"))))
    flagged = methods.withColumn("reason", F.when(~ok, "unbalanced braces").when(n == 0, "no lines"))
    return (flagged.where(F.col("reason").isNull()).drop("reason"),
            flagged.where(F.col("reason").isNotNull()))
