"""Registered queries on unspaced source: lexer, A1, A5-A8, A11, A14, A15, F2.

The oracles do not parse.  The lexer's is a pattern of its own for RE2; those of
the tree state, member by member of the fixture, which tags, methods and
statements a reader of the text expects, and add up line numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lexer import lex
from ..operators import source_tree as S
from ..sources import fixtures as fx
from . import oracle_exprs as X
from .registry import query


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else "NULL" if v is None else str(v).lower()
                                                 for v in r) + ")" for r in rows)


_LINES = _values((k, off, text) for k, m in enumerate(fx.JAVA_MEMBERS) for off, text in enumerate(m))
_SIZES = _values((k, len(m)) for k, m in enumerate(fx.JAVA_MEMBERS))

_FIX = f"""
j_items AS (
  SELECT l_orderkey AS file_id, rn, k, size, 3 + CAST(sum(size) OVER (PARTITION BY l_orderkey ORDER BY rn) AS INTEGER) - size AS first_line FROM (
    SELECT l_orderkey, CAST(l_partkey % {len(fx.JAVA_MEMBERS)} AS INTEGER) AS k, CAST(row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS rn FROM lineitem)
  JOIN ({_SIZES}) s(sk, size) ON sk = k),
j_lines AS (
  SELECT file_id, rn, k, off, first_line + off AS line_no, replace(line, '#', CAST(rn AS VARCHAR)) AS line
  FROM j_items JOIN ({_LINES}) t(tk, off, line) ON tk = k),
j_files AS (
  SELECT file_id, 'package p; // {{' || chr(10) || 'public class C' || file_id || ' {{' || chr(10) || string_agg(line, chr(10) ORDER BY line_no)
    || chr(10) || CASE file_id % 13 WHEN 0 THEN '' WHEN 1 THEN '}}}}' WHEN 2 THEN 'class X{{class Y{{' ELSE '}}' END AS src,
    CASE file_id % 13 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN 3 ELSE 0 END AS depth
  FROM j_lines GROUP BY file_id),
j_methods AS (
  SELECT file_id, rn, k, string_agg(line, chr(10) ORDER BY off) AS src FROM j_lines WHERE k IN (0, 2, 5, 6, 8, 9) GROUP BY file_id, rn, k)"""


def _with(body: str, *ctes: str) -> str:
    return "WITH " + ",".join((_FIX, *ctes)) + "\n" + body


# The token grammar again, for RE2 (no possessive loops, no look-around).
_RE = "|".join((
    r"[ \t\n\x0b\f\r]+", r"//[^\r\n]*", r"(?s:/\*.*?\*/)", r'(?s:"""(?:[^\\]|\\.)*?""")', r'"(?:[^"\\\r\n]|\\.)*"',
    r"''(?:[^''\\\r\n]|\\.)*''", r"[\pL_$][\pL\p{Nd}_$]*", r"[0-9]+", r"->|\+\+|--|==|<=|>=", r"(?s:.)"))
_LEXED = (f"j_lexed AS (SELECT file_id, regexp_extract_all(src, '{_RE}') AS p FROM j_files)",
          "j_words AS (SELECT file_id, list_filter(p, lambda t: NOT regexp_matches(t, '^(\\s|//|/\\*)')) AS w FROM j_lexed)")


@query("lex_source_tokens", _with(
    """SELECT file_id, CAST(count(*) AS INTEGER) AS n_pieces, CAST(sum("at") AS BIGINT) AS at_sum, CAST(sum(line) AS BIGINT) AS line_sum,
 count(*) FILTER (t[1:2] IN ('//', '/*')) AS n_comments, count(*) FILTER (t[1] IN ('"', '''')) AS n_literals,
 string_agg(t, ' ' ORDER BY i) FILTER (NOT regexp_matches(t, '^(\\s|//|/\\*)')) AS words FROM (
 SELECT file_id, i, t, sum(length(t)) OVER w - length(t) AS "at",
  1 + sum(length(t) - length(replace(t, chr(10), ''))) OVER w - (length(t) - length(replace(t, chr(10), ''))) AS line
 FROM (SELECT file_id, unnest(p) AS t, generate_subscripts(p, 1) AS i FROM j_lexed)
 WINDOW w AS (PARTITION BY file_id ORDER BY i ROWS UNBOUNDED PRECEDING)) GROUP BY file_id""", _LEXED[0]))
def lex_source_tokens(spark, sf_dir):
    x = fx.java_files(spark, sf_dir).select("file_id", lex(F.col("src")).alias("p"))
    total = lambda f: F.aggregate("p", F.lit(0).cast("long"), lambda s, t: s + t[f])
    some = lambda *kinds: F.size(F.filter("p", lambda t: t["kind"].isin(*kinds))).cast("long")
    words = F.transform(F.filter("p", lambda t: ~t["kind"].isin("space", "comment")), lambda t: t["text"])
    return x.select("file_id", F.size("p").alias("n_pieces"), total("at").alias("at_sum"), total("line").alias("line_sum"),
                    some("comment").alias("n_comments"), some("string", "char", "text").alias("n_literals"),
                    F.array_join(words, " ").alias("words"))


@query("repair_unclosed_source", _with(
    f"""SELECT file_id, depth, depth BETWEEN 0 AND 2 AS parse_ok, CASE WHEN depth BETWEEN 0 AND 2
 THEN src || CASE depth WHEN 0 THEN '' WHEN 1 THEN chr(10) || '}}' ELSE chr(10) || '}} }}' END
 ELSE replace(replace(regexp_replace(src, '{X.WS}*([().]){X.WS}*', '\\1', 'g'), chr(13), ' '), chr(9), ' ') || ' }} }} }}' END AS code
 FROM j_files"""))
def repair_unclosed_source(spark, sf_dir):
    x = fx.java_files(spark, sf_dir).select("file_id", S.repair_unclosed_source(F.col("src")).alias("r"))
    return x.select("file_id", "r.depth", "r.parse_ok", "r.code")


@query("source_marker_indexes", _with(
    """SELECT file_id, CAST(len(w) AS INTEGER) AS n_words,
 CAST(coalesce(len(w) - nullif(list_position(list_reverse(w), 'try'), 0), -1) AS INTEGER) AS try_idx,
 CAST(coalesce(len(w) - nullif(list_position(list_reverse(w), 'catch'), 0), -1) AS INTEGER) AS catch_idx FROM j_words""", *_LEXED))
def source_marker_indexes(spark, sf_dir):
    x = fx.java_files(spark, sf_dir).select("file_id", S.source_markers(F.col("src")).alias("m"))
    return x.select("file_id", "m.n_words", "m.try_idx", "m.catch_idx")


@query("segment_source_statements", _with(
    f"SELECT file_id, {X.iv_text(X.intervals('ends'))} AS intervals FROM j_ends",
    *_LEXED, f"j_ends AS (SELECT file_id, {X.statements('w')} AS ends FROM j_words)"))
def segment_source_statements(spark, sf_dir):
    x = fx.java_files(spark, sf_dir).select("file_id", S.source_statements(F.col("src")).alias("iv"))
    return x.select("file_id", F.array_join(F.transform("iv", lambda z: F.concat_ws(
        "-", z["s"].cast("string"), z["e"].cast("string"))), ",").alias("intervals"))


@query("drop_unparsed_sources", _with("SELECT file_id FROM j_files WHERE depth = 0"))
def drop_unparsed_sources(spark, sf_dir):
    return S.split_parsed_sources(fx.java_files(spark, sf_dir))[0].select("file_id")


@query("quarantine_unparsed_sources", _with(
    "SELECT file_id, CASE WHEN depth > 0 THEN 'unclosed braces' ELSE 'closing braces without an opening one' END AS reason "
    "FROM j_files WHERE depth <> 0"))
def quarantine_unparsed_sources(spark, sf_dir):
    return S.split_parsed_sources(fx.java_files(spark, sf_dir))[1].select("file_id", "reason")


# The tag of each line of the members that are methods (member, line, tag).
_TAGS = (
    (0, 0, "MethodDeclaration END"),
    (2, 0, "MethodDeclaration"), (2, 1, "TryStatement"), (2, 2, "MethodInvocation"), (2, 3, "ThrowStatement"),
    (2, 4, "LocalVariableDeclaration"), (2, 5, "Assignment"), (2, 6, "MethodDeclaration END"),
    (5, 0, "MethodDeclaration"), (5, 1, "ReturnStatement"), (5, 2, "MethodInvocation"), (5, 3, None),
    (5, 4, "MethodDeclaration END"),
    (6, 0, "MethodDeclaration"), (6, 1, "LocalVariableDeclaration"), (6, 2, None), (6, 3, None), (6, 4, "MethodInvocation"),
    (6, 5, "MethodInvocation"), (6, 6, None), (6, 7, "MethodDeclaration END"),
    (8, 0, "MethodDeclaration"), (8, 1, "SwitchStatement"), (8, 2, "StatementExpression"), (8, 3, "BreakStatement"),
    (8, 4, "ReturnStatement"), (8, 5, None), (8, 6, "BlockStatement"), (8, 7, "StatementExpression"), (8, 8, None),
    (8, 9, "WhileStatement"), (8, 10, "BreakStatement"), (8, 11, "LocalVariableDeclaration"), (8, 12, None),
    (8, 13, "ReturnStatement"), (8, 14, "MethodDeclaration END"),
    (9, 0, "MethodDeclaration"), (9, 1, None), (9, 2, "IfStatement"), (9, 3, "MethodInvocation"), (9, 4, "BlockStatement"),
    (9, 5, "Assignment"), (9, 6, "StatementExpression"), (9, 7, "ThrowStatement"), (9, 8, "MethodDeclaration END"),
)


@query("tag_source_lines", _with(
    f"SELECT file_id, rn, off + 1 AS line_no, tag FROM j_items JOIN ({_values(_TAGS)}) t(tk, off, tag) ON tk = k"))
def tag_source_lines(spark, sf_dir):
    x = fx.java_methods(spark, sf_dir).select("file_id", "rn", F.posexplode_outer(S.tag_source_lines("lines")).alias("i", "tag"))
    return x.where("i is not null").select("file_id", "rn", (F.col("i") + 1).cast("int").alias("line_no"), "tag")


# Methods in the order in which they begin: member, place, name, has a body,
# first and last line within the member.
_METHODS = (
    (0, 0, "f#", True, 0, 0), (2, 0, "g#", True, 0, 6), (3, 0, "h#", True, 1, 1), (4, 0, "k#", True, 0, 0),
    (4, 1, "l#", True, 0, 0), (5, 0, "r#", True, 0, 4), (5, 1, "run", True, 2, 2), (6, 0, "t#", True, 0, 7),
    (7, 0, "z#", False, 1, 1), (8, 0, "w#", True, 0, 14), (9, 0, "m#", True, 0, 8),
)


@query("extract_nested_methods", _with(
    f"""SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY rn, ord) AS method_no, replace(name, '#', CAST(rn AS VARCHAR)) AS name,
 body AS has_body, first_line + a AS start_line, first_line + z AS end_line, CAST(z - a + 1 AS BIGINT) AS n_lines
 FROM j_items JOIN ({_values(_METHODS)}) t(tk, ord, name, body, a, z) ON tk = k"""))
def extract_nested_methods(spark, sf_dir):
    return S.extract_nested_methods(fx.java_files(spark, sf_dir)).drop("text")


# Statements directly in a method's body: member, number, kind, first and last
# line within the member, first word.
_BODY = (
    (0, 0, "ReturnStatement", 0, 0, "return a+1;"),
    (2, 0, "TryStatement", 1, 3, None), (2, 1, "LocalVariableDeclaration", 4, 4, "int[] x = {1,2};"),
    (2, 2, "Assignment", 5, 5, "x[0]=3;"),
    (5, 0, "ReturnStatement", 1, 3, None),
    (6, 0, "LocalVariableDeclaration", 1, 3, None), (6, 1, "MethodInvocation", 4, 6, None),
    (8, 0, "SwitchStatement", 1, 5, None), (8, 1, "DoStatement", 6, 8, None), (8, 2, "WhileStatement", 9, 10, "while(true)\n      break;"),
    (8, 3, "LocalVariableDeclaration", 11, 12, "int total = c\n      + 1;"), (8, 4, "ReturnStatement", 13, 13, "return c;"),
    (9, 0, "IfStatement", 2, 5, None), (9, 1, "SynchronizedStatement", 6, 6, "synchronized (this){ n++; }"),
    (9, 2, "ThrowStatement", 7, 7, 'throw new E("try");'),
)


@query("explode_body_statements", _with(
    f"""SELECT file_id, rn, no AS stmt_no, kind, a + 1 AS start_line, z + 1 AS end_line, coalesce(own, (
   SELECT ltrim(string_agg(line, chr(10) ORDER BY off)) FROM j_lines l WHERE l.file_id = j.file_id AND l.rn = j.rn AND off BETWEEN a AND z)) AS text
 FROM j_items j JOIN ({_values(_BODY)}) t(tk, no, kind, a, z, own) ON tk = k"""))
def explode_body_statements(spark, sf_dir):
    return S.explode_body_statements(fx.java_methods(spark, sf_dir), ("file_id", "rn"))


# The marker stream of the members that are methods, as read from their text.
_STREAMS = (
    (0, "MethodDeclaration int f# parameters ( int a ) { RETURN BinaryOperation a + operandr 1 ; }"),
    (2, "MethodDeclaration void g# parameters ( ) throws Exception { TRY { METHOD INVOCATION qualifier a b arguments ( } ) ; } "
        "CatchClause parameter ( IOException e ) { throw e ; } VarDec int [ ] x initializer { 1 , 2 } ; Assignment x [ 0 ] = value 3 ; }"),
    (5, "MethodDeclaration Runnable r# parameters ( ) { RETURN ClassCreator Runnable arguments ( ) { MethodDeclaration public void run "
        "parameters ( ) { for ( int i initializer 0 ; BinaryOperation i < operandr 3 ; i ++ ) { METHOD INVOCATION x arguments ( i ) ; } } } ; }"),
    (6, "MethodDeclaration void t# parameters ( ) { VarDec String q initializer { \\ try } ; METHOD INVOCATION qualifier l forEach "
        "arguments ( v -> { if ( BinaryOperation v > operandr 1 ) { METHOD INVOCATION y arguments ( v ) ; } } ) ; }"),
    (8, "MethodDeclaration int w# parameters ( int c ) { switch ( c ) { case 1 : c ++ ; break ; default : RETURN ; } do { c -- ; } "
        "while ( BinaryOperation c > operandr 0 ) ; outer : while ( true ) break ; VarDec int total initializer BinaryOperation c + "
        "operandr 1 ; RETURN c ; }"),
    (9, "MethodDeclaration @ Test ( Assignment expected = value A . class ) C# m# parameters ( final int a ) { if ( BinaryOperation a > "
        "operandr 0 ) METHOD INVOCATION go arguments ( a ) ; ELSE { Assignment b = value x ; } synchronized ( this ) { n ++ ; } "
        "throw ClassCreator E arguments ( try ) ; }"),
)


@query("expression_marker_stream", _with(
    f"""SELECT file_id, rn, true AS parse_ok, replace(stream, '#', CAST(rn AS VARCHAR)) AS tokens
 FROM j_items JOIN ({_values(_STREAMS)}) t(tk, stream) ON tk = k"""))
def expression_marker_stream(spark, sf_dir):
    x = fx.java_methods(spark, sf_dir).select("file_id", "rn", S.source_marker_stream("src").alias("m"))
    return x.select("file_id", "rn", "m.parse_ok", F.array_join("m.tokens", " ").alias("tokens"))
