
import pytest
from pyspark.sql import functions as F

from trylens.functions import folds, text
from trylens.functions.arrays import py_slice
from trylens.operators import metrics as G
from trylens.operators import slicing as S
from trylens.operators import spans as SP
from trylens.operators import structure as A
from trylens.plans import flows


def one(spark, col, data, schema):
    return spark.createDataFrame(data, schema).select(col.alias("r")).collect()


@pytest.mark.parametrize("preds,expected", [
    ([1, 1, 0], (0, 3)),          # a run starting at line 0 never closes
    ([0, 1, 1, 0, 1], (1, 2)),
    ([0, 0], (-1, 2)),            # no predicted line
    ([0, 1, 1], (1, 3)),          # no closing 0 -> len, not len - 1
])
def test_predicted_span(spark, preds, expected):
    r = one(spark, SP.find_predicted_span(F.col("p")), [(preds,)], "p array<int>")[0]["r"]
    assert (r["begin"], r["end"]) == expected


def test_predicted_span_fixed_variant(spark):
    r = one(spark, SP.find_predicted_span(F.col("p"), fix_line0=True), [([1, 1, 0],)], "p array<int>")[0]["r"]
    assert (r["begin"], r["end"]) == (0, 1)


@pytest.mark.parametrize("src,idx", [
    ("a b c", -1),                       # no try
    ('a " try " b', -1),                 # quoted try
    ("try x ' \" try ' y", 0),           # other quote kind inside is ignored
    ("try a try b", 2),                  # last one wins
])
def test_last_try_index(spark, src, idx):
    r = one(spark, folds.last_marker_index(text.py_split(F.col("s")), "try"), [(src,)], "s string")
    assert r[0]["r"] == idx


def test_minus_one_slicing(spark):
    r = one(spark, S.split_at_try(F.split(F.col("s"), " ")), [("a b c",)], "s string")[0]["r"]
    assert (r["try_idx"], r["front"], r["back"]) == (-1, ["a", "b"], ["c"])


@pytest.mark.parametrize("arr,start,stop,expected", [
    ([1, 2, 3], 0, -1, [1, 2]), ([1, 2, 3], -1, 5, [3]), ([1, 2, 3], 2, 1, []), ([1, 2, 3], -5, 2, [1, 2]),
])
def test_py_slice(spark, arr, start, stop, expected):
    assert one(spark, py_slice(F.col("a"), start, stop), [(arr,)], "a array<int>")[0]["r"] == expected


@pytest.mark.parametrize("src,ivs", [
    ("f ( a ; b ) ;", [(0, 6)]),                 # ';' inside parens does not split
    ("f ( ( a ) ; b ) ;", [(0, 5), (6, 8)]),     # the flag is boolean: inner ')' clears it
    ('x = " ; " ; y', [(0, 5)]),                 # quoted ';' ignored, tail dropped
    ("{ a ; }", [(0, 0), (1, 2), (3, 3)]),
])
def test_segment_statements(spark, src, ivs):
    r = one(spark, folds.segment_statements(F.split(F.col("s"), " ")), [(src,)], "s string")[0]["r"]
    assert [(x["s"], x["e"]) for x in r] == ivs


@pytest.mark.parametrize("tgt,exc", [
    ("catch ( IOException|SQLException e ) { }", "IOException, SQLException"),
    ("catch ( IOException | SQLException e ) { }", "Exception"),     # spaced union does not match
    ("catch ( final RemoteException e ) { }", "RemoteException"),
    ("catch ( java . io . IOException a ) { } catch ( SQLException b ) { }", "SQLException"),
    ("finally { }", "Exception"),
])
def test_exception_types(spark, tgt, exc):
    assert one(spark, text.extract_exception_types(F.col("t")), [(tgt,)], "t string")[0]["r"] == exc


def test_rename_documented_line(spark):
    line = "         ByteBuffer   writeBuf   =   ByteBuffer . allocateDirect ( CAPACITY_NORMAL ) ;"
    r = one(spark, text.rename_declared_variables(F.col("l")), [(line,)], "l string")[0]["r"]
    assert r == "ByteBuffer byteBuffer = ByteBuffer . allocateDirect ( CAPACITY_NORMAL ) ;"


def test_rename_after_tag_append(spark):
    # ';' glued to the tag is no longer the third word, so nothing is renamed
    r = one(spark, text.rename_declared_variables(F.col("l")), [("int n;LocalVariableDeclaration",)], "l string")
    assert r[0]["r"] == "int n;LocalVariableDeclaration"


def test_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, pred int")
    r = G.weighted_precision_recall_f1(df).collect()[0]
    assert r["precision"] == pytest.approx(7 / 9)
    assert r["recall"] == pytest.approx(2 / 3)
    assert r["f1"] == pytest.approx(0.8 * 2 / 3)


def test_method_without_positives_scores_recall_one(spark):
    df = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 0, 1), (2, 1, 1, 1)], "method_id long, line_no int, label int, pred int")
    r = G.mean_method_line_recall(G.per_method_line_stats(df)).collect()[0][0]
    assert r == pytest.approx(1.0)


def test_tie_in_counts_keeps_first_seen(spark):
    from trylens.operators.labels import count_exception_types
    from trylens.operators.util import with_position
    df = spark.createDataFrame([(5, "B"), (1, "A"), (7, "B"), (2, "A"), (9, "C")], "method_id long, exception string")
    ranked = with_position(count_exception_types(df), [F.desc("n"), F.asc("first_pos")], "rank")
    assert [r["exception"] for r in ranked.orderBy("rank").collect()] == ["A", "B", "C"]


def test_trailing_partial_window_not_reported(spark):
    rows = [(0, b, 1.0, 8, 16) for b in range(250)]
    df = spark.createDataFrame(rows, "epoch int, batch int, loss double, correct int, total int")
    out = G.training_window_rollup(df).collect()
    assert sorted(r["win"] for r in out) == [0, 1]
    assert all(r["accuracy_pct"] == 50.0 for r in out)


def test_more_than_fifty_lines(spark):
    lines = ["public void m ( ) {"] + [f"n{i} = {i} ;" for i in range(60)] + ["}"]
    df = spark.createDataFrame([(1, "train", lines, [0] * 62, " ".join(lines))],
                               "method_id long, split string, lines array<string>, labels array<int>, src string")
    r = flows.task1_corpus(df).collect()[0]
    assert r["lines_count"] == 62 and len(r["lines"]) == 50 and len(r["labels"]) == 50


def test_empty_method_is_dropped(spark):
    df = spark.createDataFrame([(1, "train", [], [], "")],
                               "method_id long, split string, lines array<string>, labels array<int>, src string")
    assert flows.task1_corpus(df).count() == 0


def test_merge_appends_tag_without_separator(spark):
    df = spark.createDataFrame([(["void m ( ) {", "foo ( a ,", ", b ) ;", "}"], [0, 1, 0, 0])],
                               "lines array<string>, labels array<int>")
    merged = A.merge_statement_lines(F.col("lines"), F.col("labels"), A.tag_lines(F.col("lines")))
    r = df.select(merged.alias("m")).collect()[0]["m"]
    assert [(g["text"], g["label"]) for g in r] == [
        ("void m ( ) {MethodDeclaration", 0), ("foo ( a ,, b ) ;MethodInvocation", 1), ("}MethodDeclaration END", 0)]


def test_hash_record_spans(spark):
    r = one(spark, SP.parse_hash_record(F.col("v")), [("void,m#a,b,c#IOException,X#1,9\n",), ("x#y#z",)], "v string")
    assert r[1]["r"] is None
    assert (r[0]["r"]["front"], r[0]["r"]["back"], r[0]["r"]["exception"]) == ("void m a", "b c", "IOException")


def test_insert_try_block_negative_begin(spark):
    c = SP.insert_try_block(F.col("l"), F.lit(-1), F.lit(3))
    r = one(spark, c, [(["a", "b", "c"],)], "l array<string>")[0]["r"]
    assert r == "a\nb\ntry {\nc\n} catch ( Exception e ) { } \n"


def test_exception_types_unicode_option(spark):
    tgt = "catch ( ÜberException e ) { }"
    ascii_ = one(spark, text.extract_exception_types(F.col("t")), [(tgt,)], "t string")[0]["r"]
    uni = one(spark, text.extract_exception_types(F.col("t"), unicode=True), [(tgt,)], "t string")[0]["r"]
    assert (ascii_, uni) == ("Exception", "ÜberException")


def test_exact_match_within_lines_count(spark):
    # method 1 differs only after its lines_count (2), so it matches within but not overall
    rows = [(1, 1, 0, 0, 2), (1, 2, 1, 1, 2), (1, 3, 0, 1, 2), (2, 1, 1, 0, 3)]
    df = spark.createDataFrame(rows, "method_id long, line_no int, label int, pred int, lc int")
    st = G.per_method_line_stats(df, lines_count="lc")
    within = G.exact_match_rate(st, "match_within").collect()[0]
    padded = G.exact_match_rate(st, "match_all").collect()[0]
    assert (within["hits"], padded["hits"], within["total"]) == (1, 0, 2)


def test_slice_quality_split_and_observe(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], [1, 1, 0]), (2, ["a"], [1]), (3, ["a", "b"], [1])],
                               "id int, front array<string>, mask array<int>")
    good, bad, obs = S.split_quality(df)
    assert [r["id"] for r in good.collect()] == [1]
    assert obs.get == {"good": 1, "quarantined": 2}
    assert sorted((r["id"], r["reason"]) for r in bad.collect()) == [
        (2, "at most one token kept"), (3, "mask length differs")]


def test_split_parsed_quarantine(spark):
    df = spark.createDataFrame(
        [(1, ["void m ( ) {", "}"], [0, 0], "void m ( ) { }"),
         (2, ["void m ( ) {", "if ( a ) {"], [0, 0], "void m ( ) { if ( a ) {"),
         (3, [], [], "")],
        "method_id long, lines array<string>, labels array<int>, src string")
    kept, bad = A.split_parsed(df)
    assert [r["method_id"] for r in kept.collect()] == [1]
    assert sorted((r["method_id"], r["reason"]) for r in bad.collect()) == [(2, "unbalanced braces"), (3, "no lines")]
