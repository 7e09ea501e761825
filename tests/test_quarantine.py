"""Routing to kept and set-aside rows; line-kind rules as data; split positions."""

import pytest
from pyspark.sql import functions as F

from trylens.operators import quarantine as Q
from trylens.operators import structure as A
from trylens.sources import text as TX


def test_hash_records_lose_no_row(spark):
    rows = [(1, "i#a,b#E#0,1"), (2, "i#a#E"), (3, "i#a#E#x,1"), (4, "i#a#E#1"), (5, None), (6, ""), (7, "i#a#E# 0 , 2 \n")]
    kept, aside, counts = Q.route_hash_records(spark.createDataFrame(rows, "id int, value string"))
    assert {r["id"]: r["record"]["end"] for r in kept.collect()} == {1: 1, 7: 2}
    assert {r["id"]: r["reason"] for r in aside.collect()} == {
        2: "too few fields", 3: "bad span", 4: "bad span", 5: "too few fields", 6: "too few fields"}
    assert counts == {"kept": 2, "set_aside": 5}


def test_triples_of_unequal_files(spark):
    frame = lambda c, v: spark.createDataFrame(list(enumerate(v)), f"pos int, {c} string")
    kept, aside, counts = Q.route_training_triples(frame("in_try", [" a ", "b", "c"]), frame("before_try", ["x", "y", "z", "w"]),
                                                   frame("label_text", ["1", "one"]))
    assert [tuple(r) for r in kept.collect()] == [(0, "a", "x", "1", 1)]
    assert {r["pos"]: r["reason"] for r in aside.collect()} == {
        1: "label is no integer", 2: "no line in label_text", 3: "no line in in_try, label_text"}
    assert counts == {"kept": 1, "set_aside": 3}


def test_route_of_nothing_and_of_clashing_columns(spark):
    kept, aside, counts = Q.route(spark.createDataFrame([], "a int"), F.lit("x"), "none")
    assert kept.count() == aside.count() == 0 and counts == {"kept": 0, "set_aside": 0} and kept.columns == ["a"]
    with pytest.raises(ValueError):
        Q.route(spark.createDataFrame([(1,)], "verdict int"), F.lit(None), "clash")


def test_slices_with_nulls(spark):
    rows = [(1, [1, 1], ["a", "b"]), (2, [1, 0], ["a", "b"]), (3, [1, 1], ["a"]), (4, None, ["a"])]
    kept, aside, _ = Q.route_sliced(spark.createDataFrame(rows, "k int, mask array<int>, front array<string>"))
    assert {r["k"] for r in kept.collect()} == {1} and aside.count() == 3


def test_built_in_rules_as_a_table_tag_alike(spark):
    lines = ["void m ( ) {", "try {", "} catch ( E e ) {", "if ( a ) {", "if ( a )", "int x = 1 ;", "x = 2 ;", "f ( ) ;", "return x ;", ", w )", "}"]
    rules = A.rules_from(A.rules_frame(spark))
    df = spark.createDataFrame([(lines,)], "l array<string>")
    a, b = df.select(A.tag_lines(F.col("l")), A.tag_lines(F.col("l"), rules)).first()
    assert a == b and rules == A.LINE_KIND_RULES


def test_rules_are_bounded_and_known(spark):
    with pytest.raises(ValueError):
        A.rules_from(A.rules_frame(spark, [("word", ("a",), "T")] * (A.MAX_RULES + 1)))
    with pytest.raises(ValueError):
        A.rules_from(A.rules_frame(spark, [("glob", "a*", "T")]))


def test_positions_when_splits_are_sorted_into_ranges(spark, tmp_path):
    spark.range(500).selectExpr("cast(id as string) AS value").repartitionByRange(7, F.col("value").cast("int")).write.text(str(tmp_path / "t"))
    got = TX.read_positional(spark, str(tmp_path / "t")).orderBy("pos").collect()
    assert [(r["pos"], r["value"]) for r in got] == [(i, str(i)) for i in range(500)]
