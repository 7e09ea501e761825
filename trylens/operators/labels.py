"""Exception labels: extraction, label-map lookup, decoding and type counts.

The label map is a fixed, small table (10 or 52 classes), so it is broadcast
after its size is checked; the per-method side is never shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_exception_types


def exception_types(df: DataFrame, tgt_col: str = "tgt", out: str = "exception") -> DataFrame:
    """P7 as a projection: add the extracted (defaulted) exception type."""
    return df.withColumn(out, extract_exception_types(F.col(tgt_col)))


def map_exception_label(df: DataFrame, label_map: DataFrame, type_col: str = "exception",
                        out: str = "label") -> DataFrame:
    """Look the whole type string up in the map; unknown -> 0."""
    m = F.broadcast(label_map.select(F.col("name").alias("_name"),
                                            F.col("class_id").alias("_cid")))
    joined = df.join(m, F.col(type_col) == F.col("_name"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_cid"), F.lit(0)).cast("int")).drop("_name", "_cid")


def decode_class(df: DataFrame, label_map: DataFrame, id_col: str = "class_id",
                 out: str = "exception") -> DataFrame:
    """Class id -> name.  An id missing from the map is an error, as in the
    reference (a ``KeyError``): the plan carries an ``assert_true`` on it."""
    m = F.broadcast(label_map.select(F.col("class_id").alias("_cid"),
                                            F.col("name").alias("_name")))
    joined = df.join(m, F.col(id_col) == F.col("_cid"), "left")
    checked = F.when(F.assert_true(F.col("_name").isNotNull() | F.col(id_col).isNull(),
                                   F.lit("class id not in label map")).isNull(), F.col("_name"))
    return joined.withColumn(out, checked).drop("_cid", "_name")


def count_exception_types(df: DataFrame, type_col: str = "exception",
                          pos_col: str = "method_id") -> DataFrame:
    """Count per type, most frequent first; ties in first-seen order.

    Returns type, n, first_pos; ``rank_by`` gives the report order.  The map
    side combines partial counts before the shuffle, so a hot type costs one
    row per partition.
    """
    return df.groupBy(F.col(type_col).alias("exception")).agg(
        F.count("*").alias("n"), F.min(pos_col).alias("first_pos"))


def distinct_exception_types(df: DataFrame, type_col: str = "exception") -> DataFrame:
    """The set of types (no order)."""
    return df.select(F.col(type_col).alias("exception")).distinct()


def first_listed_exception(fields: F.Column) -> F.Column:
    """First comma entry of field 2 of a split ``#`` record."""
    return F.split(fields[2], ",")[0]
