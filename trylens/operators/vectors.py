"""Feature vectors (M2, M3): element-wise pooling and concatenation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_pool_vectors(df: DataFrame, group: str, vec: str) -> DataFrame:
    """M2: element-wise mean of the member vectors per group (long form).

    ``(group, dim, value)``; every position counts, padding included.  The
    partial averages combine map-side, so a large group is not gathered.
    """
    x = df.select(group, F.posexplode(vec).alias("dim", "_v"))
    return x.groupBy(group, "dim").agg(F.avg(F.col("_v").cast("double")).alias("value"))


def concat_feature_vectors(df: DataFrame, first: str, second: str, out: str = "features") -> DataFrame:
    """M3: one feature vector from two (before-try and in-try)."""
    return df.withColumn(out, F.concat(F.col(first), F.col(second)))
