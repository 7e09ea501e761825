"""Structured Streaming: prediction over arriving submissions (R1) and an
idempotent feedback sink (R2).

Submissions arrive as parquet files with a declared schema.  Each micro-batch
runs the batch prediction chain against static, already-fitted models inside
``foreachBatch`` (the chain has joins and aggregations per batch, which
``foreachBatch`` allows).  The sink writes each batch to its own
``batch_id=<n>`` folder with overwrite, so a replayed batch replaces its own
output and never duplicates rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.util import stage_scope
from ..session import shared_path

SUBMISSION_SCHEMA = T.StructType([
    T.StructField("method_id", T.LongType()),
    T.StructField("code", T.StringType()),
])


def write_batch_idempotent(batch: DataFrame, batch_id: int, sink: str) -> None:
    """R2: one folder per micro-batch, overwritten on replay."""
    batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")


def read_sink(spark: SparkSession, sink: str, schema: T.StructType | None = None) -> DataFrame:
    """All drained batches (the ``batch_id`` partition column is dropped)."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(T.StructType(list(schema.fields) + [T.StructField("batch_id", T.LongType())]))
    return reader.parquet(sink).drop("batch_id")


def stream_to_sink(spark: SparkSession, source: str, schema: T.StructType, sink: str,
                   transform=None, max_files: int = 1000, name: str = "stream") -> None:
    """Drain ``source`` (parquet files) into ``sink`` with ``availableNow``."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)

    def each(batch: DataFrame, batch_id: int) -> None:
        # the tables a batch writes on its way are gone when the batch is
        with stage_scope(spark):
            out = transform(batch) if transform is not None else batch
            write_batch_idempotent(out, batch_id, sink)

    q = (stream.writeStream.foreachBatch(each)
         .option("checkpointLocation", shared_path(spark, f"{name}-checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()


def stream_feedback_sink(spark: SparkSession, records: DataFrame) -> str:
    """R2: stream feedback records (landed as parquet files, partitioned as they
    come) into an idempotent sink; returns the sink path."""
    from ..sources.tables import FEEDBACK_SCHEMA
    source = shared_path(spark, "feedback-in")
    records.write.parquet(source)
    sink = shared_path(spark, "feedback-sink")
    stream_to_sink(spark, source, FEEDBACK_SCHEMA, sink, name="feedback")
    return sink


def stream_predict_handlers(spark: SparkSession, submissions: DataFrame, line_model: DataFrame,
                            type_model: DataFrame, label_map: DataFrame) -> str:
    """Replies for submissions arriving as files; returns the sink path.

    The models are pivoted and written once, before the first batch."""
    from ..operators.models import prepare_model
    from ..plans.flows import predict_handlers
    lines, types = prepare_model(line_model), prepare_model(type_model)
    source = shared_path(spark, "submissions-in")
    submissions.write.parquet(source)
    sink = shared_path(spark, "replies-sink")
    stream_to_sink(spark, source, SUBMISSION_SCHEMA, sink,
                   transform=lambda b: predict_handlers(b, lines, types, label_map),
                   name="replies")
    return sink
