"""Streaming replay safety, stream = batch, and plan-independence properties."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_SMALL
from trylens.session import shared_path
from trylens.sources import fixtures as fx
from trylens.sources.tables import FEEDBACK_SCHEMA
from trylens.streaming import handlers as R


def test_replayed_batch_adds_no_rows(spark):
    fb = fx.feedback(spark, SF_SMALL)
    sink = R.stream_feedback_sink(spark, fb)
    n = R.read_sink(spark, sink, FEEDBACK_SCHEMA).count()
    from trylens.operators.util import materialize
    first = materialize(spark.read.parquet(f"{sink}/batch_id=0"))
    R.write_batch_idempotent(first, 0, sink)          # replay batch 0
    again = R.read_sink(spark, sink, FEEDBACK_SCHEMA)
    assert again.count() == n == fb.count()
    assert again.select("record_id").distinct().count() == n


def test_stream_equals_batch(spark):
    q = entry.queries()
    a = q["stream_predict_handlers"](spark, SF_SMALL)
    b = q["predict_handlers"](spark, SF_SMALL)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_topn_monotonic(spark):
    r = entry.queries()["topn_accuracy"](spark, SF_SMALL).collect()[0]
    vals = [r[c] for c in ("top1", "top2", "top3", "top5", "top10")]
    assert vals == sorted(vals) and vals[-1] == 1.0


def test_shuffle_partition_invariance(spark):
    q = entry.queries()
    names = ("count_exception_types", "merge_statement_lines", "assign_batches", "seeded_shuffle")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        res = {}
        for parts in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            res[parts] = {n: sorted(map(tuple, q[n](spark, SF_SMALL).collect())) for n in names}
        assert res["3"] == res["11"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_shared_path_under_checkpoint_root(spark):
    p = shared_path(spark, "x")
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert p.startswith(root.rstrip("/"))


def test_filters_reach_the_scan(spark):
    from trylens.sources import tables
    path = shared_path(spark, "fb")
    tables.append_feedback(fx.feedback(spark, SF_SMALL), path)
    df = tables.read_feedback(spark, path).where(F.col("exception_predict") == "IOException").select("record_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(exception_predict), EqualTo(exception_predict,IOException)]" in plan


def test_stream_leaves_no_stage_tables(spark, tmp_path):
    """Tables that micro-batches write on their way are removed with the batch."""
    import os
    import uuid
    from trylens.operators.util import materialize, stage_scope
    source, sink = shared_path(spark, "scoped-in"), shared_path(spark, "scoped-sink")
    spark.range(90).repartition(3).write.parquet(source)
    root = os.path.dirname(sink).removeprefix("file:")
    own = f"leftover-{uuid.uuid4().hex}"            # the root may hold tables of earlier runs

    def staged():
        return {d for d in os.listdir(root) if d.startswith(own)}
    R.stream_to_sink(spark, source, spark.read.parquet(source).schema, sink, max_files=1,
                     transform=lambda b: materialize(materialize(b, own).where("id % 2 = 0"), own))
    assert spark.read.parquet(sink).count() == 45 and not staged()
    with stage_scope(spark):
        materialize(spark.range(3), own)
        assert len(staged()) == 1
    assert not staged()
    materialize(spark.range(3), own)
    assert len(staged()) == 1


def test_prepared_model_scores_alike(spark):
    import pytest
    from trylens.operators import models as M
    docs = spark.createDataFrame([(1, 0, ["a", "b", "a"]), (2, 1, ["b", "c"]), (3, 1, []), (4, 0, None), (5, 2, None)],
                                 "id int, label int, tokens array<string>")
    model = M.fit_naive_bayes(docs)
    a = M.class_scores(docs, model).collect()
    assert sorted(map(str, a)) == sorted(map(str, M.class_scores(docs, M.prepare_model(model, write=True)).collect()))
    assert {r["class_id"] for r in model.collect()} == {0, 1, 2}
    many = spark.range(M.MAX_CLASSES + 1).selectExpr("cast(id AS int) AS label", "array('x') AS tokens")
    with pytest.raises(ValueError):
        M.fit_naive_bayes(many)
