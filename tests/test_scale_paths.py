"""Code paths that only large inputs take, forced on small data."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from trylens.operators import encode as E
from trylens.operators import models as M
from trylens.operators.util import running_sum, with_position
from trylens.plans import flows


def test_line_keys_hold_for_long_methods_and_large_ids(spark):
    """1,001 lines in one method do not meet the next method's lines."""
    rows = [(1, [f"a{i}" for i in range(1001)]), (2, ["b0", "b1"]), (1 << 61, ["c"])]
    docs = flows.line_feature_docs(spark.createDataFrame(rows, "method_id long, lines array<string>"))
    assert docs.select("line_key").distinct().count() == 1004 == docs.count()


def test_class_without_tokens_keeps_its_prior(spark):
    docs = spark.createDataFrame(
        [(1, 0, ["a", "b"]), (2, 1, ["a"]), (3, 2, []), (4, 2, []), (5, 2, [])],
        "id long, label int, tokens array<string>")
    model = M.fit_naive_bayes(docs)
    prior = {r["class_id"]: round(math.exp(r["prior"]), 6) for r in model.collect()}
    assert prior == {0: 0.2, 1: 0.2, 2: 0.6}
    assert [(r["token"], r["log_lik"], round(math.exp(r["unseen"]), 6)) for r in model.where("class_id = 2").collect()] \
        == [(None, None, 0.5)]
    got = {r["id"]: (r["class_id"], len(r["scores"])) for r in M.class_scores(docs.select("id", "tokens"), model).collect()}
    assert got[3] == (2, 3) and len(got) == 5


def test_predictions_reach_past_the_padding_length(spark):
    methods = spark.createDataFrame(
        [(1, "train", ["x"] * 3, [0, 0, 0], "catch (IOException e) { }"),
         (2, "train", ["open ( f ) ;"], [1], "catch (IOException e) { }")],
        "method_id long, split string, lines array<string>, labels array<int>, tgt string") \
        .withColumn("src", F.array_join("lines", "\n"))
    label_map = spark.createDataFrame([(0, "Exception"), (1, "IOException")], "class_id int, name string")
    line_model, type_model = flows.fit_handler_models(methods, label_map)
    code = "\n".join(["x"] * 60 + ["open ( f ) ;"] * 2 + ["x"] * 3)
    short = spark.createDataFrame([(7, code), (8, "x")], "method_id long, code string")
    got = {r["method_id"]: r["line_predict"].split(",") for r in
           flows.predict_handlers(short, line_model, type_model, label_map).collect()}
    assert len(got[7]) == 65 and got[7][60:62] == ["1", "1"] and len(got[8]) == 50


def test_empty_token_rows_do_not_meet_at_one_key(spark):
    df = spark.createDataFrame([(1, ["a", "zz"]), (2, []), (3, [])], "k int, t array<string>")
    vocab = E.build_vocabulary(spark.createDataFrame([("a",), ("a",), ("b",)], "token string"))
    got = {r["k"]: r["ids"] for r in E.encode_token_arrays(df, ["k"], "t", vocab).collect()}
    assert got == {1: [4, 1], 2: [], 3: []}
    assert [r["id"] for r in E.build_vocabulary(df.selectExpr("explode(t) AS token"), 1).collect()] == [4]


def test_running_sum_multi_chunk(spark):
    rows = [(f, i, (i * 7 + f) % 5 - 2) for f in range(3) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "f long, i int, v int")
    got = running_sum(df, "f", "i", "v", "rs", chunk=4)
    w = Window.partitionBy("f").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("rs", F.sum("v").over(w))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_positions_over_many_partitions(spark):
    df = spark.range(0, 5000, 1, 13).withColumn("k", (F.col("id") * 7919) % 5000)
    pos = with_position(df, [F.col("k")], "pos")
    bad = pos.where(F.col("pos") != F.col("k"))
    assert pos.count() == 5000 and bad.count() == 0


def test_methods_by_row_and_by_line_agree(spark):
    from trylens.operators import structure as A
    files = spark.createDataFrame([
        (1, ["class C {", "void a ( ) {", "x ( ) ;", "}", "int f ;", "void b ( ) {", "if ( y ) {", "}", "}", "}"]),
        (2, ["class D {", "}"]), (3, []), (4, ["class E {", "void c ( ) {"]),
    ], "file_id long, lines array<string>")
    by_row = A.extract_methods_from_files(files)
    lines = files.select("file_id", F.posexplode("lines").alias("line_no", "line")) \
                 .withColumn("line_no", F.col("line_no") + 1)
    want = [(1, 1, 2, 4, 3), (1, 2, 6, 9, 4), (4, 1, 2, 2, 1)]
    for got in (by_row, A.extract_methods(lines)):
        assert sorted(tuple(r) for r in got.select("file_id", "method_no", "start_line", "end_line", "n_lines").collect()) == want


def test_depth_of_a_source_is_worked_out_once_per_side(spark):
    """The filter moves below the text's projection; it must not multiply the lexer."""
    from trylens.operators import source_tree as S
    files = spark.createDataFrame([(1, ["a {", "}"]), (2, ["a {"]), (3, ["}"]), (4, [" "]), (5, None)], "k int, x array<string>") \
        .select("k", F.array_join("x", "\n").alias("src"))
    kept, aside = S.split_parsed_sources(files)
    assert [r["k"] for r in kept.select("k").collect()] == [1]
    assert {r["k"]: r["reason"] for r in aside.collect()} == {
        2: "unclosed braces", 3: "closing braces without an opening one", 4: "empty", 5: "empty"}
    plan = kept.select("k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join") == 1 and plan.count("regexp_extract_all") == 1


def test_folds_go_through_their_own_tokens_alone(spark):
    """Depth, markers and statements as of a fold over all tokens."""
    from trylens.functions import folds
    rows = [("a", ["x", "{", '"', "}", "'", '"', "try", "}", "(", ";", ")", ";", "}"]), ("b", []), ("c", ["try", '"', "try", ";"])]
    df = spark.createDataFrame(rows, "k string, t array<string>")
    got = {r["k"]: (r["d"], r["m"], [(z["s"], z["e"]) for z in r["s"]]) for r in df.select(
        "k", folds.brace_depth(F.col("t")).alias("d"), folds.last_marker_index(F.col("t"), "try").alias("m"),
        folds.segment_statements(F.col("t")).alias("s")).collect()}
    assert got == {"a": (-1, 6, [(0, 1), (2, 7), (8, 11), (12, 12)]), "b": (0, -1, []), "c": (0, 0, [])}


def test_white_space_and_newlines_cost_no_regex_or_table_per_character(spark):
    from trylens.functions.lexer import _newlines
    from trylens.functions.text import py_split, py_strip
    df = spark.createDataFrame([(" 　a\n bé \x1f",)], "t string")
    x = df.select(py_strip(F.col("t")).alias("s"), py_split(F.col("t")).alias("w"), _newlines(F.col("t")).alias("n"))
    assert tuple(x.first()) == ("a\n bé", ["a", "bé"], 1)
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "translate" not in plan and "split(" not in plan


def test_topk_sorts_its_rows_once(spark):
    from trylens.operators.ranking import topk_classes
    x = topk_classes(spark.range(60).selectExpr("id % 6 AS id", "CAST(id AS INT) AS class_id", "CAST(id % 7 AS DOUBLE) AS logit"), 2)
    assert x._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert [(r["id"], r["rank"], r["class_id"]) for r in x.orderBy("id", "rank").limit(2).collect()] == [(0, 1, 6), (0, 2, 48)]


def test_marker_stream_is_taken_over_arrow_batches(spark):
    from trylens.operators import structure as A
    rows = [(0, 'try { Foo x = a . b ( "p q" ) ;'), (1, None), (2, '" { \' } " } } } x'), (3, "")]
    x = spark.createDataFrame(rows, "i int, s string").coalesce(1)
    r = x.select("i", A.repair_unclosed_method(F.col("s")).alias("r"))
    assert "ArrowEvalPython" in r._jdf.queryExecution().executedPlan().toString()
    got = {q["i"]: q["r"] for q in r.collect()}
    assert (got[0]["depth"], got[2]["depth"], got[3]["depth"], got[1]["depth"]) == (1, -3, 0, None)
    assert got[0]["tokens"] == ["TRY", "{", "VarDec", "Foo", "x", "initializer", "qualifier", "a", "METHOD", "INVOCATION", "b",
                                "arguments", "(", "p", "q", ")", ";", "}"]
    assert not got[2]["parse_ok"] and got[2]["tokens"][-3:] == ["}", "}", "}"]
    assert got[3]["tokens"] == [] and got[1]["tokens"] is None


def test_front_back_over_arrow_batches(spark):
    from trylens.operators import structure as A
    rows = [(0, "a TRY b CatchClause c".split()), (1, 'a " TRY " CatchClause \' x'.split()), (2, None), (3, []), (4, "CatchClause TRY b".split())]
    x = spark.createDataFrame(rows, "i int, t array<string>").coalesce(1).select("i", A.split_front_back_at_catch(F.col("t")).alias("r"))
    assert "ArrowEvalPython" in x._jdf.queryExecution().executedPlan().toString()
    got = {q["i"]: tuple(q["r"]) for q in x.collect()}
    assert got == {0: (1, 3, ["a"], ["TRY", "b"]), 1: (-1, 4, 'a " TRY " CatchClause \''.split(), []),
                   2: (None, None, None, None), 3: (-1, -1, [], []), 4: (1, 0, ["CatchClause"], [])}


def test_statement_starts_are_found_once_a_method(spark):
    from trylens.operators.structure import merge_statement_lines
    x = spark.range(1).selectExpr("transform(sequence(1, 3000), i -> concat('a', i)) AS l", "transform(sequence(1, 3000), i -> i) AS b",
                                  "transform(sequence(1, 3000), i -> if(i % 2 = 0, 'T', null)) AS t")
    m = x.select(merge_statement_lines(F.col("l"), F.col("b"), F.col("t")).alias("m"))
    assert m._jdf.queryExecution().analyzed().toString().count("filter(") == 1
    got = m.first()["m"]
    assert len(got) == 1500 and tuple(got[0]) == ("a2a3T", 2) and tuple(got[-1]) == ("a3000T", 3000)
