"""Kept rows and set-aside rows from one evaluation of the input.

``route`` writes the input once, partitioned by verdict, and counts both sides
while it does; the two frames read their own partition.  No row is lost and no
bad row ends the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..session import shared_path
from .slicing import quality_gate
from .spans import parse_hash_record

KEPT, SET_ASIDE = "kept", "set_aside"


def route(df: DataFrame, reason: Column, name: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(kept rows, set-aside rows with ``reason``, counts {kept, set_aside}).

    A row is set aside when ``reason`` is not null.  ``df`` must not have
    columns named verdict or reason."""
    if clash := {"verdict", "reason"} & set(df.columns):
        raise ValueError(f"input has columns of the result: {sorted(clash)}")
    spark = df.sparkSession
    seen = Observation(name)
    x = df.withColumn("reason", reason.cast("string"))
    x = x.withColumn("verdict", F.when(F.col("reason").isNull(), KEPT).otherwise(SET_ASIDE)).observe(
        seen, F.count(F.lit(1)).alias("all"), F.count("reason").alias(SET_ASIDE))
    path = shared_path(spark, name)
    x.write.partitionBy("verdict").parquet(path)
    back = spark.read.schema(x.schema).parquet(path)
    counts = {KEPT: seen.get["all"] - seen.get[SET_ASIDE], SET_ASIDE: seen.get[SET_ASIDE]}
    return (back.where(F.col("verdict") == KEPT).drop("verdict", "reason"),
            back.where(F.col("verdict") == SET_ASIDE).drop("verdict"), counts)


def route_hash_records(records: DataFrame, value: str = "value"):
    """Records with a parsed ``record``, and those without four fields or
    with a span that is not two integers."""
    x = records.withColumn("record", parse_hash_record(F.col(value)))
    fields = F.size(F.split(F.coalesce(F.col(value), F.lit("")), "#", -1))
    return route(x, F.when(F.col("record").isNull(), F.when(fields < 4, "too few fields").otherwise("bad span")), "hash-records")


def route_sliced(sliced: DataFrame):
    """slices that pass the quality gate, and the others."""
    reason = F.when(~F.coalesce(quality_gate(F.col("mask"), F.col("front")), F.lit(False)), F.when(
        F.size("mask") != F.size("front"), "mask length differs").otherwise("at most one token kept"))
    return route(sliced, reason, "slice-quality")


def route_training_triples(in_try: DataFrame, before_try: DataFrame, labels: DataFrame):
    """S3 without a stop: positional frames (pos, in_try), (pos, before_try) and
    (pos, label_text) as triples; lines without a partner and labels that are no
    integers are set aside."""
    j = in_try.join(before_try, "pos", "full").join(labels, "pos", "full")
    x = j.select("pos", py_strip(F.col("in_try")).alias("in_try"), py_strip(F.col("before_try")).alias("before_try"),
                 "label_text", py_strip(F.col("label_text")).try_cast("int").alias("label"))
    gaps = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in ("in_try", "before_try", "label_text")])
    reason = F.when(gaps != "", F.concat(F.lit("no line in "), gaps)).when(F.col("label").isNull(), "label is no integer")
    return route(x, reason, "training-triples")
