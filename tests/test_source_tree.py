"""Lexer and statement tree on written-out Java."""

import random

import pytest
from pyspark.sql import functions as F

from trylens.functions import lexer
from trylens.functions.tree import nodes
from trylens.functions.arrays import let
from trylens.functions.folds import brace_depth, last_marker_index, scan, segment_statements
from trylens.functions.text import py_split
from trylens.operators import source_tree as S


def one(spark, src, expr):
    return spark.createDataFrame([(src,)], "s string").select(expr(F.col("s")).alias("r")).first()["r"]


def words(spark, src):
    return one(spark, src, lexer.code_words)


@pytest.mark.parametrize("src,want", [
    ("void f(){ a(); }", ["void", "f", "(", ")", "{", "a", "(", ")", ";", "}"]),
    ("a // } { \"\n b", ["a", "b"]),
    ("a /* { ' */b", ["a", "b"]),
    ('s="{\\"}"+\'{\'+\'\\\'\';', ["s", "=", '"{\\"}"', "+", "'{'", "+", "'\\''", ";"]),
    ('q="""\n " "" \\""" {\n""";', ["q", "=", '"""\n " "" \\""" {\n"""', ";"]),
    ("x>>>=1<<2>=3!=4->y::z...", ["x", ">>>=", "1", "<<", "2", ">=", "3", "!=", "4", "->", "y", "::", "z", "..."]),
    ("0x1F 0b10L 1_0.5e-3f .5d 1..2 7.e", ["0x1F", "0b10L", "1_0.5e-3f", ".5d", "1", ".", ".2", "7", ".", "e"]),
    ("été $a _b", ["été", "$a", "_b"]),
    ('"open\nnext', ['"open', "next"]),
    ("/* open {", []), ("", []), (None, []),
])
def test_code_words(spark, src, want):
    assert words(spark, src) == want


def test_pieces_tile_the_text(spark):
    rng = random.Random(2)
    parts = ['"', "'", "\\", "\n", "//", "/*", "*/", '"""', "{", "}", "a", "é", "1", ".", "e+", " ", "\t", "->", ">", "=", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in texts], "s string").select("s", lexer.lex(F.col("s")).alias("p"))
    for s, p in df.collect():
        assert "".join(x["text"] for x in p) == s
        for x in p:
            assert s[x["at"]:x["at"] + len(x["text"])] == x["text"] and x["line"] == 1 + s[:x["at"]].count("\n")


def test_very_long_literals_and_texts(spark):
    src = '"' + "a\\n" * 60000 + '" /*' + "*x" * 60000 + '*/ """' + '\\" " ' * 30000 + '"""' + " f ( ) ;" * 20000
    assert one(spark, src, lambda c: F.size(lexer.code_words(c))) == 2 + 4 * 20000


def test_whitespace_tokens_give_the_same_words(spark):
    src = 'public void m ( Arg a ) { try { a . b ( 1 , n1 ) ; } catch ( E e ) { x >>>= 3 ; } }'
    assert words(spark, src) == src.split()
    for f in (brace_depth, segment_statements, lambda t: last_marker_index(t, "try")):
        assert one(spark, src, lambda c: let(lexer.code_words(c), f)) == one(spark, src, lambda c: let(py_split(c), f))


def test_scan_over_several_blocks(spark):
    step = lambda s, x: F.struct((s + x).alias("s"), s.alias("o"))
    got = spark.range(1).select(scan(F.sequence(F.lit(1), F.lit(50)), F.lit(0), step, "int", block=7).alias("r")).first()["r"]
    assert got["o"] == [sum(range(1, k)) for k in range(1, 51)] and got["s"] == sum(range(1, 51))
    empty = spark.range(1).select(scan(F.array().cast("array<int>"), F.lit(0), step, "int").alias("r")).first()["r"]
    assert empty["o"] == [] and empty["s"] == 0


@pytest.mark.parametrize("src,depth", [
    ("void f(){ a(); }", 0), ("void f() { try{ a(); } catch(E e){ } }", 0), ("f(){ // }\n", 1), ("f(){ s=\"}\"; /* } */", 1),
    ("}", -1), ("{{{", 3), ("", 0), (None, 0),
])
def test_source_depth(spark, src, depth):
    assert one(spark, src, S.source_depth) == depth


def test_repair_closes_behind_a_comment(spark):
    r = one(spark, "f(){ a(); // end", S.repair_unclosed_source)
    assert r["parse_ok"] and one(spark, r["code"], S.source_depth) == 0
    assert not one(spark, "}", S.repair_unclosed_source)["parse_ok"]


def methods(spark, src):
    df = spark.createDataFrame([(1, src)], "file_id int, src string")
    return [(r["name"], r["start_line"], r["end_line"], r["has_body"])
            for r in S.extract_nested_methods(df).orderBy("method_no").collect()]


def test_methods_of_nested_types(spark):
    src = """class A<T> extends B {
  int[] a = {1, 2}; int x = f(), y[] = new int[]{3};
  A(int i) { super(i); }
  @Ann(v = {"m(", X.class}) public <R> R gen(List<R> l) throws E, F { return null; }
  static { init(); } { more(); }
  class In { void in() { new Runnable() { public void run() { } }.run(); } }
  enum E { P { int p() { return 1; } }, Q(2) { int q() { return 2; } }, R; int r() { return 0; } }
  record Rec(int a) { int s() { return a; } }
  interface I { void abs(int i); default void def() { class Loc { void loc() { } } } }
  @interface N { String value() default "x"; String[] many() default {"a"}; }
  Supplier<X> z = () -> { return new X() { void anon() { } }; };
}"""
    assert methods(spark, src) == [
        ("A", 3, 3, True), ("gen", 4, 4, True), ("in", 6, 6, True), ("run", 6, 6, True), ("p", 7, 7, True), ("q", 7, 7, True),
        ("r", 7, 7, True), ("s", 8, 8, True), ("abs", 9, 9, False), ("def", 9, 9, True), ("loc", 9, 9, True),
        ("value", 10, 10, False), ("many", 10, 10, False), ("anon", 11, 11, True)]


def test_methods_of_open_and_broken_files(spark):
    assert methods(spark, "class A { void f() { if (x) {") == [("f", 1, 1, True)]
    assert methods(spark, "class A { } } void g() { }") == [("g", 1, 1, True)]
    assert methods(spark, ") } ( ; {") == [] and methods(spark, "") == [] and methods(spark, None) == []


def body(spark, src):
    df = spark.createDataFrame([(1, src)], "k int, src string")
    return [(r["kind"], r["text"]) for r in S.explode_body_statements(df, ("k",)).orderBy("stmt_no").collect()]


def test_statements_of_the_whole_body(spark):
    src = """int f(int c) throws E {
    log.info("; }");
    try { a(); b(); } catch (E e) { c(); } finally { d(); }
    after();
    if (x) y(); else if (z) { w(); } else { v(); }
    do c--; while (c > 0);
    for (int i = 0; i < 3; i++) { g(i); }
    l.forEach(v -> { h(v); k(v); });
    Object o = new Object() { int m() { return 1; } };
    a[i(1)] = 2; p.q = r; ;
    int[] b = {1, 2}, e = {}; Map<String, List<X>> m = null; final java.util.List<X> n;
    lab: while (true) break lab;
    class Loc { void u() { } }
    i++;
    assert c > 0;
    return c;
}"""
    got = body(spark, src)
    assert [k for k, _ in got] == [
        "MethodInvocation", "TryStatement", "MethodInvocation", "IfStatement", "DoStatement", "ForStatement",
        "MethodInvocation", "LocalVariableDeclaration", "Assignment", "Assignment", "LocalVariableDeclaration",
        "LocalVariableDeclaration", "LocalVariableDeclaration", "WhileStatement", "TypeDeclaration", "StatementExpression",
        "AssertStatement", "ReturnStatement"]
    assert got[1][1] == "try { a(); b(); } catch (E e) { c(); } finally { d(); }"
    assert got[3][1] == "if (x) y(); else if (z) { w(); } else { v(); }"
    assert got[4][1] == "do c--; while (c > 0);" and got[7][1].endswith("} };") and got[-1][1] == "return c;"


def tags(spark, src):
    return spark.createDataFrame([(src.split("\n"),)], "l array<string>").select(S.tag_source_lines("l")).first()[0]


def test_tags_of_nested_and_continued_lines(spark):
    src = """void f() {
  if (a
      && b) {
    foo(1,
        2);
  } else if (c)
    return;
  else
    throw new E();
  switch (x) {
    case 1:
    case 2: y = 3;
    default:
  }
  try {
    int i = 0;
  }
  catch (E e)
  {
  }
  // for (;;) {
  for (;;)
    while (q) {
    }
}"""
    assert tags(spark, src) == [
        "MethodDeclaration", "IfStatement", "BlockStatement", "MethodInvocation", None, "IfStatement", "ReturnStatement",
        None, "ThrowStatement", "SwitchStatement", "SwitchStatementCase", "Assignment", "SwitchStatementCase", None,
        "TryStatement", "LocalVariableDeclaration", None, "CatchClause", None, None, None, "ForStatement", "BlockStatement",
        None, "MethodDeclaration END"]


def test_deeper_of_two_nodes_on_a_line(spark):
    assert tags(spark, "void f() {\nif (a) { b(); }\nwhile (c) { if (d) { } }\nelse\n}")[1:3] == ["MethodInvocation", "BlockStatement"]


def test_quarantine_of_sources(spark):
    df = spark.createDataFrame([(1, "a(){}"), (2, "{"), (3, "}"), (4, None), (5, " "), (6, "// {")], "k int, src string")
    good, bad = S.split_parsed_sources(df)
    assert {r["k"] for r in good.collect()} == {1, 6}
    assert {r["k"]: r["reason"] for r in bad.collect()} == {
        2: "unclosed braces", 3: "closing braces without an opening one", 4: "empty", 5: "empty"}


def test_tree_operators_on_an_empty_table(spark):
    df = spark.createDataFrame([], "file_id int, src string")
    assert S.extract_nested_methods(df).count() == 0 and S.explode_body_statements(df, ("file_id",)).count() == 0


def test_nodes_do_not_shuffle(spark):
    df = spark.createDataFrame([(1, "a(){}")], "file_id int, src string")
    plan = S.extract_nested_methods(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan




@pytest.mark.parametrize("src,want", [
    ("int x = 1;", "VarDec int x initializer 1 ;"),
    ("a = b + c * d - e;", "Assignment a = value BinaryOperation BinaryOperation b + operandr BinaryOperation c * operandr d - operandr e ;"),
    ("if (a > 0 && !b) x = f(1, -y);", "if ( BinaryOperation BinaryOperation a > operandr 0 && operandr ! b ) "
                                       "Assignment x = value METHOD INVOCATION f arguments ( 1 , - y ) ;"),
    ("List<String> l = new ArrayList<>(3), m = null;", "VarDec List < String > l initializer ClassCreator ArrayList < > ( 3 ) , "
                                                       "m initializer null ;"),
    ('a.b.c(d.e, "x y").g();', "METHOD INVOCATION qualifier a . b c arguments ( qualifier d e , x y ) . METHOD INVOCATION g arguments ( ) ;"),
    ("return a ? b + 1 : c;", "RETURN TernaryExpression a ? BinaryOperation b + operandr 1 : c ;"),
    ("x += i >> 2;", "Assignment x += value BinaryOperation i > > operandr 2 ;"),
    ("x = (int) -y + (a + b) * c;", "Assignment x = value BinaryOperation ( int ) - y + operandr BinaryOperation "
                                    "( BinaryOperation a + operandr b ) * operandr c ;"),
    ("java.util.List<Map<A,B>> q = p;", "VarDec java . util . List < Map < A , B > > q initializer p ;"),
    ("int a = 1, b = 2, y[] = {1, 2};", "VarDec int a initializer 1 , b initializer 2 , y [ ] initializer { 1 , 2 } ;"),
    ("this.x = y instanceof Z || w == null;", "Assignment qualifier this x = value BinaryOperation BinaryOperation y instanceof "
                                              "operandr Z || operandr BinaryOperation w == operandr null ;"),
    ("a = b = c;", "Assignment a = value Assignment b = value c ;"),
    ("try { go(); } catch (java.io.IOException e) { throw e; }",
     "TRY { METHOD INVOCATION go arguments ( ) ; } CatchClause parameter ( java . io . IOException e ) { throw e ; }"),
    ("a || b && c | d ^ e & f;", "BinaryOperation a || operandr BinaryOperation b && operandr BinaryOperation c | operandr "
                                 "BinaryOperation d ^ operandr BinaryOperation e & operandr f ;"),
    ("a - b - c;", "BinaryOperation BinaryOperation a - operandr b - operandr c ;"),
])
def test_expression_markers(spark, src, want):
    r = one(spark, "void m() { " + src + " }", lambda c: S.source_marker_stream("s"))
    assert r["parse_ok"] and " ".join(r["tokens"]) == f"MethodDeclaration void m parameters ( ) {{ {want} }}"


def test_expression_markers_of_broken_code(spark):
    for src in ("", "f(a)(b", ") ;", "a + ) * ( ]"):
        one(spark, src, lambda c: S.source_marker_stream("s"))
    r = one(spark, "} a ( b ) ;", lambda c: S.source_marker_stream("s"))
    assert not r["parse_ok"] and r["tokens"][0] == "}"
    assert one(spark, None, lambda c: S.source_marker_stream("s"))["tokens"] == []


def precedence_brute(tokens):
    """Fully bracketed reading of a flat expression by climbing."""
    from trylens.functions.expressions import PRECEDENCE
    level = {o: k for k, g in enumerate(PRECEDENCE) for o in g}

    def parse(i, least):
        left, i = [tokens[i]], i + 1
        while i < len(tokens) and level[tokens[i]] >= least:
            op = tokens[i]
            right, i2 = parse(i + 1, level[op] + 1)
            left, i = ["BinaryOperation", *left, op, "operandr", *right], i2
        return left, i
    return parse(0, 0)[0]


def test_precedence_against_climbing(spark):
    rng = random.Random(4)
    ops = ["||", "&&", "|", "^", "&", "==", "!=", "<=", "<<", "+", "-", "*", "/", "%", "instanceof"]
    exprs = []
    for _ in range(60):
        e = ["v0"]
        for k in range(rng.randint(0, 9)):
            e += [rng.choice(ops), f"v{k + 1}"]
        exprs.append(e)
    from trylens.functions.expressions import marker_stream
    df = spark.createDataFrame([(e,) for e in exprs], "e array<string>").select("e", marker_stream(F.col("e")).alias("m"))
    for e, m in df.collect():
        assert m == precedence_brute(e)


def test_places_and_tree_are_taken_over_batches(spark):
    """Pieces get their places and tokens their nodes a batch at a time, not by a
    running fold over every row's array."""
    texts = ["é1 = \"a\";\n// x\n½.5", None, "", "\n\n漢 /* {\n */ '{'"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").repartition(1).select(
        "i", lexer.lex(F.col("s")).alias("p"), S.parsed("s").alias("x"))
    for plan in (df.select("p"), df.select(F.size("x.n"))):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" in text and "aggregate(" not in text
    rows = {r["i"]: r for r in df.collect()}
    assert [(p["kind"], p["at"], p["line"]) for p in rows[0]["p"] if p["kind"] != "space"] == [
        ("name", 0, 1), ("op", 3, 1), ("string", 5, 1), ("op", 8, 1), ("comment", 10, 2), ("op", 15, 3), ("number", 16, 3)]
    assert rows[1]["p"] == [] and rows[2]["p"] == []
    assert [(p["kind"], p["at"], p["line"]) for p in rows[3]["p"]] == [
        ("space", 0, 1), ("name", 2, 3), ("space", 3, 3), ("comment", 4, 3), ("space", 12, 4), ("char", 13, 4)]
    assert [rows[i]["x"]["line"] for i in range(4)] == [[1, 1, 1, 1, 3, 3], [], [], [3, 4]]


def test_nodes_of_null_and_empty_token_lists(spark):
    rows = [(0, None), (1, []), (2, ["{", "a", ";", "}"]), (3, ["}", "}"])]
    got = {r["i"]: r["n"] for r in spark.createDataFrame(rows, "i int, t array<string>").repartition(1).select(
        "i", nodes(F.col("t")).alias("n")).collect()}
    assert got[0] == [] and got[1] == [] and got[3] == []
    assert [(n["role"], n["start"], n["end"]) for n in got[2]] == [("scope", 0, 3), ("statement", 1, 2)]


def test_a_source_is_parsed_once_for_its_methods(spark):
    files = spark.createDataFrame([(1, "class A { void f() { g(); } }"), (2, ""), (3, None)], "file_id int, src string")
    for found in (S.extract_nested_methods(files), S.explode_body_statements(files, ("file_id",))):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
        assert [r["file_id"] for r in found.collect()] == [1]


def test_a_file_with_a_null_part_has_no_text(spark, tmp_path):
    from trylens.plans import catalog
    spark.createDataFrame([(1, 1, 10, 5, 2.0, 3.0), (2, 1, None, 5, 2.0, 3.0)],
                          "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, "
                          "l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["file_id"]: r for r in catalog.QUERIES["lex_source_tokens"](spark, str(tmp_path)).collect()}
    assert got[1]["n_pieces"] > 0 and got[2]["n_pieces"] == 0 and got[2]["words"] == ""
