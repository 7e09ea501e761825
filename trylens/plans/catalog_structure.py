"""Registered queries: line structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_method_source, wrap_full_method
from ..operators import structure as A
from ..sources import fixtures as fx
from . import oracle_exprs as X
from .oracle import with_fixtures
from .registry import query


# The line kinds written out for SQL: first word, words in front of a brace, and
# what a declaration and an assignment look like.
_FIRST_WORD = {"if": "IfStatement", "for": "ForStatement", "while": "WhileStatement", "do": "DoStatement",
               "switch": "SwitchStatement", "case": "SwitchStatementCase", "default": "SwitchStatementCase",
               "return": "ReturnStatement", "throw": "ThrowStatement", "break": "BreakStatement",
               "continue": "ContinueStatement", "synchronized": "SynchronizedStatement"}


def _tag_case(line: str, line_no: str, n: str) -> str:
    s = X.strip(f"regexp_replace({X.strip(line)}, '^(\\}}\\s*)+', '')")
    w = f"regexp_extract({s}, '^[0-9A-Za-z_]+')"
    words = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FIRST_WORD.items())
    return (f"(CASE WHEN {line_no} = {n} THEN 'MethodDeclaration END' WHEN {line_no} = 1 THEN 'MethodDeclaration' "
            f"WHEN {w} = 'try' THEN 'TryStatement' WHEN {w} = 'catch' THEN 'CatchClause' "
            f"WHEN right({s}, 1) = '{{' AND {w} IN ('else', 'if', 'for', 'while', 'do') THEN 'BlockStatement' "
            f"WHEN {w} IN ({', '.join(repr(k) for k in _FIRST_WORD)}) THEN CASE {w} {words} END "
            f"WHEN regexp_matches({s}, '^(?:final\\s+)?[A-Za-z_][0-9A-Za-z_.]*(?:\\s*<[^=;]*>)?(?:\\s*\\[\\s*\\])*\\s+[A-Za-z_][0-9A-Za-z_]*\\s*[=;,]') "
            "THEN 'LocalVariableDeclaration' "
            f"WHEN regexp_matches(replace(replace(replace(replace(replace({s}, '===', 'ee'), '==', 'ee'), '!=', 'ne'), '<=', 'le'), '>=', 'ge'), '=') "
            f"THEN 'Assignment' WHEN strpos({s}, '(') > 0 THEN 'MethodInvocation' END)")


_D_TAGGED = ("d_tagged", f"SELECT method_id, line_no, split, line, label, "
                         f"{_tag_case('line', 'line_no', 'max(line_no) OVER (PARTITION BY method_id)')} AS tag "
                         "FROM code_lines")
_D_GRP = ("d_grp", "SELECT *, count(tag) OVER (PARTITION BY method_id ORDER BY line_no "
                   "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM d_tagged")


def tagged_methods(spark, sf_dir):
    m = fx.methods(spark, sf_dir)
    return m.withColumn("tags", A.tag_lines(F.col("lines")))


@query("tag_line_kind", with_fixtures("SELECT method_id, line_no, tag FROM d_tagged", "code_lines",
                                      ctes=(_D_TAGGED,)))
def tag_line_kind(spark, sf_dir):
    t = tagged_methods(spark, sf_dir)
    x = t.select("method_id", F.posexplode("tags").alias("i", "tag"))
    return x.select("method_id", (F.col("i") + 1).cast("int").alias("line_no"), "tag")


# The rules of the second tagging, written out again: by hand, not from the module.
_CUSTOM = (("word", ("try", "catch"), "Guard"), ("regex", r"^int\s", "Int"), ("word{", ("for", "if"), "Head"),
           ("contains", " . ", "Call"))


@query("tag_line_kind_by_rules", with_fixtures(
    f"""SELECT method_id, line_no, CASE WHEN line_no = n THEN 'MethodDeclaration END' WHEN line_no = 1 THEN 'MethodDeclaration'
 WHEN w IN ('try', 'catch') THEN 'Guard' WHEN starts_with(s, 'int ') THEN 'Int' WHEN w IN ('for', 'if') AND s[-1] = '{{' THEN 'Head'
 WHEN contains(s, ' . ') THEN 'Call' END AS tag FROM (
 SELECT method_id, line_no, max(line_no) OVER (PARTITION BY method_id) AS n, s, regexp_extract(s, '^(\\w+)', 1) AS w FROM (
  SELECT method_id, line_no, {X.strip("ltrim(trim(line), '} ')")} AS s FROM code_lines))""", "code_lines"))
def tag_line_kind_by_rules(spark, sf_dir):
    """A1 with a rule table given as a DataFrame."""
    rules = A.rules_from(A.rules_frame(spark, _CUSTOM))
    t = fx.methods(spark, sf_dir).select("method_id", F.posexplode(A.tag_lines(F.col("lines"), rules)).alias("i", "tag"))
    return t.select("method_id", (F.col("i") + 1).cast("int").alias("line_no"), "tag")


@query("merge_statement_lines", with_fixtures(
    "SELECT method_id, CAST(grp - 1 AS INTEGER) AS group_no, string_agg(line, '' ORDER BY line_no) || max(tag) AS text, "
    "arg_min(label, line_no) AS label FROM d_grp WHERE grp > 0 GROUP BY method_id, grp",
    "code_lines", ctes=(_D_TAGGED, _D_GRP)))
def merge_statement_lines(spark, sf_dir):
    t = tagged_methods(spark, sf_dir)
    x = t.select("method_id", F.posexplode(A.merge_statement_lines(F.col("lines"), F.col("labels"),
                                                                   F.col("tags"))).alias("group_no", "g"))
    return x.select("method_id", "group_no", "g.text", "g.label")


@query("append_line_tags", with_fixtures(
    "SELECT method_id, line_no, line || coalesce(tag, '') AS text FROM d_tagged", "code_lines", ctes=(_D_TAGGED,)))
def append_line_tags(spark, sf_dir):
    t = tagged_methods(spark, sf_dir)
    x = t.select("method_id", F.posexplode(A.append_line_tags(F.col("lines"), F.col("tags"))).alias("i", "text"))
    return x.select("method_id", (F.col("i") + 1).cast("int").alias("line_no"), "text")


@query("true_line_counts", with_fixtures(
    "SELECT method_id, CAST(count(tag) AS INTEGER) AS lines_count FROM d_tagged GROUP BY method_id",
    "code_lines", ctes=(_D_TAGGED,)))
def true_line_counts(spark, sf_dir):
    t = tagged_methods(spark, sf_dir)
    merged = A.merge_statement_lines(F.col("lines"), F.col("labels"), F.col("tags"))
    return t.select("method_id", F.size(merged).alias("lines_count"))


def _depth_sql(toks: str) -> str:
    return (f"list_reduce({toks}, lambda acc, tk: struct_pack(q := {X.next_quote('acc.q', 'tk')}, "
            "d := acc.d + CASE WHEN acc.q <> '' THEN 0 WHEN tk = '{' THEN 1 WHEN tk = '}' THEN -1 ELSE 0 END), "
            "struct_pack(q := '', d := 0)).d")


_FUNC = f"({X.clean_src('src')} || tgt || chr(10) || ' }}')"
_D_REPAIR = ("d_rep", f"SELECT method_id, func, {_depth_sql(X.split_ws('func'))} AS depth FROM "
                      f"(SELECT method_id, {_FUNC} AS func FROM methods)")


@query("repair_unclosed_method", with_fixtures(
    f"""SELECT method_id, CAST(depth AS INTEGER) AS depth, depth BETWEEN 0 AND 2 AS parse_ok,
 CASE WHEN depth BETWEEN 0 AND 2 THEN func || repeat(' }}', depth)
 ELSE replace(replace(regexp_replace(func, '{X.WS}*([().]){X.WS}*', '\\1', 'g'), chr(13), ' '), chr(9), ' ') || ' }} }} }}' END AS code
 FROM d_rep""", "methods", ctes=(_D_REPAIR,)))
def repair_unclosed_method(spark, sf_dir):
    m = fx.methods(spark, sf_dir)
    func = wrap_full_method(clean_method_source(F.col("src")), F.col("tgt"))
    r = m.select("method_id", A.repair_unclosed_method(func, tokens=False).alias("r"))
    return r.select("method_id", "r.depth", "r.parse_ok", "r.code")


@query("structural_token_stream", with_fixtures(
    f"""SELECT method_id, depth BETWEEN 0 AND 2 AS parse_ok, array_to_string(CASE WHEN depth BETWEEN 0 AND 2
 THEN {X.structural_stream("func || repeat(' }', depth)")}
 ELSE {X.split_ws(f"replace(replace(regexp_replace(func, '{X.WS}*([().]){X.WS}*', '\\1', 'g'), chr(13), ' '), chr(9), ' ') || ' }} }} }}'")} END, ' ') AS tokens
 FROM d_rep""", "methods", ctes=(_D_REPAIR,)))
def structural_token_stream(spark, sf_dir):
    m = fx.methods(spark, sf_dir)
    func = wrap_full_method(clean_method_source(F.col("src")), F.col("tgt"))
    r = m.select("method_id", A.repair_unclosed_method(func).alias("r"))
    return r.select("method_id", "r.parse_ok", F.array_join("r.tokens", " ").alias("tokens"))


_MARK = ("d_mark", f"""SELECT method_id, list_concat(
 list_transform({X.split_ws('src')}, lambda tk: CASE WHEN tk = 'try' THEN 'TRY' ELSE tk END),
 list_transform({X.split_ws('tgt')}, lambda tk: CASE WHEN tk = 'catch' THEN 'CatchClause' ELSE tk END)) AS toks
 FROM methods""")
_MARK_IX = ("d_markix", f"SELECT *, {X.last_marker('toks', 'TRY')} AS try_idx, "
                        f"{X.last_marker('toks', 'CatchClause')} AS catch_idx FROM d_mark")


def _marker_split(spark, sf_dir):
    m = fx.methods(spark, sf_dir)
    return m.select("method_id", A.split_front_back_at_catch(A.marker_tokens(F.col("src"), F.col("tgt"))).alias("x"))


@query("last_try_marker_index", with_fixtures("SELECT method_id, try_idx FROM d_markix", "methods",
                                              ctes=(_MARK, _MARK_IX)))
def last_try_marker_index(spark, sf_dir):
    return _marker_split(spark, sf_dir).select("method_id", "x.try_idx")


@query("last_catch_marker_index", with_fixtures("SELECT method_id, catch_idx FROM d_markix", "methods",
                                                ctes=(_MARK, _MARK_IX)))
def last_catch_marker_index(spark, sf_dir):
    return _marker_split(spark, sf_dir).select("method_id", "x.catch_idx")


@query("split_front_back_at_catch", with_fixtures(
    f"SELECT method_id, try_idx, catch_idx, {X.join_sp(X.py_slice('toks', None, 'try_idx'))} AS front, "
    f"{X.join_sp(X.py_slice('toks', 'try_idx', 'catch_idx'))} AS back FROM d_markix",
    "methods", ctes=(_MARK, _MARK_IX)))
def split_front_back_at_catch(spark, sf_dir):
    x = _marker_split(spark, sf_dir)
    return x.select("method_id", "x.try_idx", "x.catch_idx", F.array_join("x.front", " ").alias("front"),
                    F.array_join("x.back", " ").alias("back"))


def class_files(spark, sf_dir):
    """Files of up to three consecutive balanced methods (``method_id div 3``)
    under a ``class C {`` header and a ``}`` footer: file_id and its ordered lines."""
    m = fx.methods(spark, sf_dir).where(A.method_is_balanced(F.col("src")))
    g = m.groupBy(F.floor(F.col("method_id") / 3).cast("long").alias("file_id")).agg(
        F.array_sort(F.collect_list(F.struct("method_id", "lines"))).alias("ms"))
    lines = F.concat(F.array(F.lit("class C {")), F.flatten(F.transform("ms", lambda x: x["lines"])),
                     F.array(F.lit("}")))
    return g.select("file_id", lines.alias("lines"))


_FILES = ("d_files", f"""SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY k1, k2) AS BIGINT) AS line_no, line FROM (
 SELECT method_id // 3 AS file_id, method_id AS k1, line_no AS k2, line FROM code_lines
  WHERE method_id IN (SELECT method_id FROM methods WHERE {_depth_sql(X.split_ws('src'))} = 0)
 UNION ALL SELECT method_id // 3, min(method_id) - 1, 0, 'class C {{' FROM methods WHERE {_depth_sql(X.split_ws('src'))} = 0 GROUP BY 1
 UNION ALL SELECT method_id // 3, max(method_id) + 1, 0, '}}' FROM methods WHERE {_depth_sql(X.split_ws('src'))} = 0 GROUP BY 1)""")
_FILE_DEPTH = ("d_fdepth", f"""SELECT *, sum(net) OVER w AS after_d, sum(net) OVER w - net AS before_d FROM (
 SELECT *, {_depth_sql(X.split_ws('line'))} AS net FROM d_files) WINDOW w AS (PARTITION BY file_id ORDER BY line_no
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
_FILE_M = ("d_fm", """SELECT *, sum(CASE WHEN before_d = 1 AND net > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id
 ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS method_no FROM d_fdepth""")


@query("extract_methods", with_fixtures(
    "SELECT file_id, CAST(method_no AS BIGINT) AS method_no, CAST(min(line_no) AS INTEGER) AS start_line, "
    "CAST(max(line_no) AS INTEGER) AS end_line, count(*) AS n_lines "
    "FROM d_fm WHERE method_no > 0 AND (before_d >= 2 OR (before_d = 1 AND net > 0)) GROUP BY file_id, method_no",
    "methods", ctes=(_FILES, _FILE_DEPTH, _FILE_M)))
def extract_methods(spark, sf_dir):
    return A.extract_methods_from_files(class_files(spark, sf_dir))


_PARSED = ("d_parsed", f"""SELECT m.method_id, m.split, {_depth_sql(X.split_ws('m.src'))} = 0 AS ok, t.n
 FROM methods m JOIN (SELECT method_id, count(tag) AS n FROM d_tagged GROUP BY method_id) t ON t.method_id = m.method_id""")


@query("drop_unparsed_methods", with_fixtures(
    "SELECT method_id, split FROM d_parsed WHERE ok AND n > 0", "methods", ctes=(_D_TAGGED, _PARSED)))
def drop_unparsed_methods(spark, sf_dir):
    return A.split_parsed(fx.methods(spark, sf_dir))[0].select("method_id", "split")


@query("quarantine_unparsed_methods", with_fixtures(
    "SELECT method_id, CASE WHEN NOT ok THEN 'unbalanced braces' ELSE 'no lines' END AS reason "
    "FROM d_parsed WHERE NOT (ok AND n > 0)", "methods", ctes=(_D_TAGGED, _PARSED)))
def quarantine_unparsed_methods(spark, sf_dir):
    return A.split_parsed(fx.methods(spark, sf_dir))[1].select("method_id", "reason")
