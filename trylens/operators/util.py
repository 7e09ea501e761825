"""Shared plan utilities: global positions, written intermediates, running sums."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_scopes = threading.local()         # a stack of lists of written paths


def with_position(df: DataFrame, order: list[Column | str], name: str = "pos") -> DataFrame:
    """Attach a 0-based global position in ``order`` without a one-partition window.

    The sort range-partitions the rows; each row records its partition id and
    its index inside the partition (``monotonically_increasing_id`` keeps the
    partition id in the upper bits) and the result is written once, so the
    ids are fixed facts of the table, whatever later plans do.  Per-partition
    row counts (one row per partition, bounded by the partition count) give
    prefix offsets that are broadcast back.  ``order`` must be a total order.
    """
    x = materialize(df.orderBy(*order)
                    .withColumn("_pid", F.spark_partition_id())
                    .withColumn("_mid", F.monotonically_increasing_id()), "positions")
    sizes = x.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return x.join(F.broadcast(offsets), "_pid").select(
        *[F.col(c) for c in df.columns], (F.col("_off") + local).cast("long").alias(name))


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage when one intermediate feeds several consumers.

    Writes ``df`` once as a parquet table under the shared
    ``spark.checkpoint.dir`` root (reliable storage, survives executor loss)
    and reads it back.  One job computes the input; ``DataFrame.checkpoint``
    would compute it twice (count, then the checkpoint write) unless cached.
    """
    from ..session import shared_path
    spark = df.sparkSession
    path = shared_path(spark, name)
    if getattr(_scopes, "open", None):
        _scopes.open[-1].append(path)
    df.write.parquet(path)
    return spark.read.parquet(path)


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that ``materialize`` writes inside the block (in this
    thread) when it ends.  Results must be written elsewhere before that."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    _scopes.open.append([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _scopes.open.pop():
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def running_sum(df: DataFrame, part: str, order: str, value: Column | str, out: str,
                chunk: int = 4096) -> DataFrame:
    """Inclusive running sum of ``value`` per ``part`` in ``order`` (an integer
    position), safe when one ``part`` holds a large share of all rows.

    Two levels: rows are cut into chunks of ``chunk`` positions; sums within a
    chunk use a window partitioned by (part, chunk), so a hot part spreads over
    many tasks; chunk totals (``chunk`` times fewer rows) get their prefix
    offsets per part and are joined back.
    """
    v = F.col(value) if isinstance(value, str) else value
    x = df.withColumn("_v", v).withColumn("_chunk", F.floor(F.col(order) / chunk))
    totals = x.groupBy(part, "_chunk").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(part, "_chunk", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(part, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_in", F.sum("_v").over(inside))
    return x.join(offsets, [part, "_chunk"]).withColumn(out, F.col("_off") + F.col("_in")) \
            .drop("_v", "_chunk", "_in", "_off")
