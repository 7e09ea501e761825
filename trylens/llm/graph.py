"""Connected components of an edge table, by repeated Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); the
    component is its smallest node.

    Each round takes the smallest label among the neighbours and then follows
    labels one step further, so long chains need a logarithmic number of
    rounds.  Labels are written each round, which cuts the lineage."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where("a <> b").distinct(), "graph-edges")
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).select(F.col("a").alias("node"), "c")
    labels = materialize(labels, "graph-labels")
    while True:
        near = (both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("c").alias("near")))
        step = labels.join(near, F.col("node") == F.col("a")) \
                     .select("node", "c", F.least("c", "near").alias("n"))
        to = labels.select(F.col("node").alias("t"), F.col("c").alias("tc"))
        step = step.join(to, F.col("n") == F.col("t")).select("node", "c", F.least("n", "tc").alias("n"))
        step = materialize(step, "graph-labels")
        changed = step.where("c <> n").limit(1).count()
        labels = step.select("node", F.col("n").alias("c"))
        if not changed:
            return labels.select("node", F.col("c").alias("component"))
