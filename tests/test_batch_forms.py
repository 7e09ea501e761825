"""What large tables need in Arrow batches, against the column expressions or plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trylens.functions.arrays import pad_to
from trylens.functions.text import py_strip, rename_declared_variables
from trylens.operators import encode as E
from trylens.operators import structure as A
from trylens.operators import tokenizers as K
from trylens.plans import flows


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_line_corpus_against_the_expressions(spark):
    rng = random.Random(3)
    parts = ["int  n = 3 ;", "    Widget w1    = f ( ) ;", "try {", "} catch ( E e ) {", "}", "n1 = w2 ;", ", w2 )", "", "  ", None,
             "if ( a ) {", "[PAD]", " return x ;", "Été é ;", "a . b ( \" { \" ) ;", "for (;;)"]
    rows = []
    for k in range(200):
        n = rng.choice((0, 1, 2, 5, 70))
        lines = [rng.choice(parts) for _ in range(n)]
        src = rng.choice([" ".join(x or "" for x in lines), "{ }", "", None, "{"])
        rows.append((k, "s", None if rng.random() < 0.1 else lines, None if rng.random() < 0.1 else [rng.choice((0, 1, None)) for _ in lines], src))
    df = spark.createDataFrame(rows, "method_id long, split string, lines array<string>, labels array<int>, src string")
    got = flows.task1_corpus(df)
    assert "MapInArrow" in plan(got) and "regexp" not in plan(got)
    merged = A.merge_statement_lines(F.col("lines"), F.col("labels"), A.tag_lines(F.col("lines")))
    x = df.where(A.method_is_balanced(F.col("src"))).select("method_id", "split", merged.alias("m")).where(F.size("m") > 0)
    texts = pad_to(F.transform("m", lambda g: g["text"]), 50, "[PAD]")
    want = x.select("method_id", "split", F.size("m").alias("lines_count"),
                    F.transform(texts, lambda ln: F.when(ln == "[PAD]", ln).otherwise(rename_declared_variables(py_strip(ln)))).alias("lines"),
                    pad_to(F.transform("m", lambda g: g["label"]), 50, 0).alias("labels"))
    rows = got.orderBy("method_id").collect()
    assert rows == want.orderBy("method_id").collect() and len(rows) > 50
    assert flows.task1_corpus(df.limit(0)).count() == 0


def test_line_corpus_needs_a_label_a_statement(spark):
    df = spark.createDataFrame([(1, "s", ["a ( ) {", "b ( ) ;", "}"], [0], "{ }")],
                               "method_id long, split string, lines array<string>, labels array<int>, src string")
    with pytest.raises(Exception, match="1 labels"):
        flows.task1_corpus(df).collect()


def test_encoding_facts(spark, monkeypatch):
    rows = [(1, [[2, 9, 3, 0], [0, 0, 0, 0]], [[1, 1, 1, 0], [0, 0, 0, 0]]), (2, [[0, 5], [7]], [[1, 1], [1]]), (3, [], []),
            (4, None, None), (5, [[1, 2]], [[1, 1], [1]]), (6, [[4, 0]], [[1, 0]])]
    df = spark.createDataFrame(rows, "k int, i array<array<int>>, m array<array<int>>").repartition(1)
    one = df.select("k", E.encoding_facts("i").alias("f")).select("k", "f.*")
    assert "ArrowEvalPython" in plan(one) and "lambda" not in plan(one)
    assert [tuple(r) for r in one.orderBy("k").collect()] == [
        (1, 2, "[4]", 3, 15), (2, 2, "[2, 1]", 2, 19), (3, 0, "[]", 0, 0), (4, None, None, None, None), (5, 1, "[2]", 2, 2), (6, 1, "[2]", 1, 0)]
    both = df.select("k", E.encoding_and_mask_facts("i", "m").alias("f")).select("k", "f.n_nonzero", "f.mask_fits")
    assert [tuple(r) for r in both.orderBy("k").collect()] == [(1, 3, True), (2, 2, False), (3, 0, True), (4, None, None), (5, 2, None), (6, 1, True)]
    monkeypatch.setattr(E, "CELLS", 1)
    lists = pa.array([r[1] for r in rows], pa.list_(pa.list_(pa.int32())))
    assert E._facts_in_runs(lists, None, E._FACTS).field("ids_by_place").to_pylist() == [15, 19, 0, None, 2, 0]


@pytest.mark.parametrize("same_hash", (False, True))
def test_vocabulary_lookup_by_hash(monkeypatch, same_hash):
    words = ["", "a", "b", "ab", "é", "aé"]
    if same_hash:
        monkeypatch.setattr(K, "token_hashes", lambda t: np.ones(len(t), dtype=np.uint64))
    find = K.vocabulary_encoder(*K.sorted_vocabulary(pa.array(words), np.arange(6) + 4), 1)
    flat, counts = find(pa.array([["zz"], ["aé", "x", None, ""], None, ["b", "b"]]).slice(1))
    assert flat.tolist() == [9, 1, 1, 4, 6, 6] and counts.tolist() == [4, 0, 2]
    empty = K.vocabulary_encoder(*K.sorted_vocabulary(pa.array([], pa.string()), np.arange(0)), 1)
    assert empty(pa.array([["a"], []], pa.list_(pa.string())))[0].tolist() == [1]


def test_encoding_without_masks(spark):
    df = spark.createDataFrame([(1, ["a b", "[PAD]"])], "k int, lines array<string>")
    vocab = spark.createDataFrame([("a", 4, 1)], "token string, id int, n long")
    assert E.encode_lines(df, ["k"], "lines", vocab, 5, masks=False).collect() == [(1, [[2, 4, 1, 3, 0], [0] * 5])]


def test_source_operators_walk_in_batches(spark):
    from trylens.operators import source_tree as S
    df = spark.createDataFrame([(1, "class A { void f() { int x = 1; } }", ["void f() {", "g();", "}"])], "file_id int, src string, lines array<string>")
    found = (S.extract_nested_methods(df), S.explode_body_statements(df, ("file_id",)), df.select(S.tag_source_lines("lines").alias("t")))
    for x in found:
        assert "ArrowEvalPython" in plan(x) and "lambda" not in plan(x)
    assert [x.count() for x in found] == [1, 1, 1]


def test_markers_walk_in_batches(spark):
    from trylens.operators import source_tree as S
    x = spark.createDataFrame([("void f() { a = b + c; ", )], "src string").select(S.source_marker_stream("src").alias("m"))
    assert "ArrowEvalPython" in plan(x) and "aggregate(" not in plan(x)
    assert " ".join(x.first()["m"]["tokens"]) == "MethodDeclaration void f parameters ( ) { Assignment a = value BinaryOperation b + operandr c ; }"


def test_methods_of_sources_put_together_by_a_group(spark):
    from trylens.operators import source_tree as S
    lines = spark.createDataFrame([(k % 3, k, "void f%d() { }" % k) for k in range(9)], "file_id int, k int, line string")
    files = lines.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("b")) \
                 .select("file_id", F.array_join(F.transform("b", lambda s: s["line"]), "\n").alias("src"))
    assert [(r["file_id"], r["name"], r["text"]) for r in S.extract_nested_methods(files).orderBy("file_id", "method_no").collect()] == [
        (k, f"f{i}", "void f%d() { }" % i) for k in range(3) for i in range(k, 9, 3)]
    assert S.explode_body_statements(files, ("file_id",)).count() == 0


@pytest.mark.parametrize("text,kind", [
    ("finàl x = 1 ;", "LocalVariableDeclaration"), ("finàl List x = 1 ;", "Assignment"), ("final List x = 1 ;", "LocalVariableDeclaration"),
    ("漢 字 , b ;", "LocalVariableDeclaration"), ("a½ b ;", "LocalVariableDeclaration"), ("½a b ;", "StatementExpression"),
    ("List < é > x ;", "LocalVariableDeclaration"), ("f ( a = b ) ;", "MethodInvocation"), ("x [ f ( 1 ) ] = 2 ;", "Assignment"),
    ("new A = b ;", "Assignment"), ("return x ;", "ReturnStatement"), ("", "StatementExpression")])
def test_statement_kinds(text, kind):
    from trylens.functions.tree import statement_kind
    assert statement_kind(["{", *text.split()], 1) == kind
