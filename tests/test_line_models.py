"""Line and type models: tokens made, counted and summed in Arrow batches."""

import pytest
from pyspark.sql import functions as F

from trylens.functions import streams as S
from trylens.functions.text import py_split, py_strip, rename_declared_variables
from trylens.operators import models as M
from trylens.operators import structure as A
from trylens.plans import flows

LINES = [
    ["public void f ( ) {", "  int\tA = 1 ;", "Foo    bar = g ( x ) ;", "} catch ( E e ) {", " x = y ; ", "", " ", "}"],
    ["Éa b ;"], ["A b = c ;", "}"], [], None, ["x", None, "try {", "} } if ( a ) {", "for", "a == b", "a = b"], [None],
    ["m {", "Map < A , B > m = f ;", "  Foo  x", "B   b   ;  ", "İx y = z ;", "case 1 :", "else", "else {", "a b", "}"],
]


def _native(spark):
    """``LINES`` with their model words by Spark's own expressions."""
    x = spark.createDataFrame([(i, ls) for i, ls in enumerate(LINES)], "method_id long, lines array<string>")
    tagged = A.append_line_tags(F.col("lines"), A.tag_lines(F.col("lines")))
    words = F.transform(tagged, lambda ln: py_split(rename_declared_variables(py_strip(ln))))
    return x, {r["method_id"]: r["w"] for r in x.select("method_id", words.alias("w")).collect()}


def test_line_words_are_those_of_the_expressions(spark):
    x, own = _native(spark)
    got = {r["method_id"]: r["w"] for r in x.select("method_id", A.line_words_in_context("lines").alias("w")).collect()}
    for i, ws in own.items():
        if ws is None:
            assert got[i] is None
            continue
        at = lambda k: (ws[k] or []) if 0 <= k < len(ws) else []  # noqa: E731,B023
        assert got[i] == [None if w is None else w + ["p:" + t for t in at(k - 1)] + ["n:" + t for t in at(k + 1)]
                          for k, w in enumerate(ws)]


def test_lines_are_counted_as_their_rows(spark, monkeypatch):
    """Lists of lines give the model of one row a line, also with labels that are
    missing, too few or too many, and in small pieces."""
    labels = [[0] * 8, [1], [1, 0], [], [1, 1], [0, 1, None, 1], [1], None]
    rows = [(i, ls, lb) for i, (ls, lb) in enumerate(zip(LINES, labels))] + [(9, ["a b"], [1, 0, 0])]
    x = spark.createDataFrame(rows, "method_id long, lines array<string>, labels array<int>")
    key = lambda m: sorted((str(r["class_id"]), str(r["token"]), round(r["log_lik"] or 0, 9), round(r["prior"], 9))
                           for r in m.collect())
    want = key(M.fit_naive_bayes(flows.line_feature_docs(x)))
    assert key(flows.fit_line_model(x)) == want
    monkeypatch.setattr(S, "_ITEMS", 1)
    assert key(flows.fit_line_model(x.coalesce(1))) == want


def test_type_tokens_are_those_of_the_columns(spark):
    texts = ["void f ( ) { try { a . b ( ) ; } catch ( E e ) { } ", "void f { { { { { try x . y ( z ) catch\t( E e )", "} } }", None, "",
             'int n = g ( " try a { " ) ; try { Foo b = c ; ', "' \" ' try catch }", "a ( . ) b\r ( c"]
    x = spark.createDataFrame(list(enumerate(texts)), "id int, func string")
    s = A.split_front_back_at_catch(A.repair_unclosed_method(F.col("func"))["tokens"])
    want = x.select("id", s.alias("s")).select("id", M.prefixed_tokens(("f:", F.col("s.front")), ("b:", F.col("s.back"))).alias("t"))
    import pyarrow as pa
    _, _, got = A.read_repaired_method([pa.array(texts)])
    assert got.arrow().to_pylist() == [r["t"] for r in want.orderBy("id").collect()]
    y = spark.createDataFrame([(0, "a try b", "catch ( c"), (1, None, "catch"), (2, "x", None), (3, "x y", "z"), (4, "", "")],
                              "id int, src string, tgt string")
    s = A.split_front_back_at_catch(A.marker_tokens(F.col("src"), F.col("tgt")))
    want = y.select("id", s.alias("s")).select("id", M.prefixed_tokens(("f:", F.col("s.front")), ("b:", F.col("s.back"))).alias("t"))
    rows = y.orderBy("id").collect()
    _, _, got = S.read_front_back([pa.array([r["src"] for r in rows], pa.string()), pa.array([r["tgt"] for r in rows], pa.string())])
    assert got.arrow().to_pylist() == [r["t"] for r in want.orderBy("id").collect()]


@pytest.mark.parametrize("head", [0, 60, None])
def test_scores_with_a_part_of_the_model_broadcast(spark, head):
    """Tokens beyond the broadcast part are joined; the scores are the same."""
    docs = spark.createDataFrame([(1, 0, ["a", "b", "a", None]), (2, 1, ["b", "c", "zz"]), (3, 1, []), (4, 0, None), (5, 2, ["a"]), (1, 0, ["c"])],
                                 "id int, label int, tokens array<string>")
    model = M.fit_naive_bayes(docs.where("id < 5"))
    prepared = M.prepare_model(model, head_bytes=head)
    assert (prepared.tail is None) == (head is None) and len(prepared.head.value[0]) == {0: 0, 60: 1, None: 4}[head]
    got = {r["id"]: ([round(s["score"], 5) for s in r["scores"]], r["class_id"]) for r in M.class_scores(docs, prepared).collect()}
    m = model.collect()
    classes = {r["class_id"]: (r["prior"], r["unseen"]) for r in m}
    lik = {(r["class_id"], r["token"]): r["log_lik"] for r in m if r["token"]}
    known = {t for _, t in lik}
    tokens = {1: ["a", "b", "a", "c"], 2: ["b", "c", "zz"], 3: [], 4: [], 5: ["a"]}
    for i, ts in tokens.items():
        want = [round(p + sum(lik.get((c, t), u) for t in ts if t in known), 5) for c, (p, u) in sorted(classes.items())]
        assert got[i][0] == want and got[i][1] == sorted(classes)[want.index(max(want))]


def test_scoring_explodes_and_joins_no_token_of_a_broadcast_model(spark):
    docs = spark.createDataFrame([(1, 0, ["a", "b"]), (2, 1, ["b", "c"])], "id int, label int, tokens array<string>")
    plan = M.class_scores(docs, M.fit_naive_bayes(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "MapInArrow" in plan
