"""Try-block slicing of method sources.

All per-method work is one projection: the token array is bound once, each
fold runs once per row, and the results travel together in one struct.  No
shuffle is needed; the stage is a map over the method table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import json_int_list, let, py_slice
from ..functions.folds import (backward_slice_mask, last_marker_index, segment_statements,
                               slice_seeds)
from ..functions.text import clean_method_source, py_split


def source_tokens(src: F.Column) -> F.Column:
    """P2 cleaning, then a whitespace split (``str.split()``)."""
    return py_split(clean_method_source(src))


def split_at_try(tokens: F.Column) -> F.Column:
    """A6 + A9: struct(try_idx, front, back); ``front = tokens[:try]``, ``back = tokens[try:]``.

    With no ``try`` (-1) Python slicing gives all but the last token as front.
    """
    return let(tokens, lambda t: let(last_marker_index(t, "try"), lambda i: F.struct(
        i.alias("try_idx"),
        py_slice(t, None, i).alias("front"),
        py_slice(t, i, None).alias("back"))))


def slice_methods(df: DataFrame, src_col: str = "src", keep: tuple[str, ...] = ()) -> DataFrame:
    """The full slicing stage: tokens, try split, statements, seeds and mask.

    Output columns: ``keep`` + try_idx, front, back, statements, seeds, mask.
    Statements and seeds are folded once and handed to the backward walk.
    """
    sliced = split_methods(df, src_col, keep).select(
        *keep, "try_idx", "front", "back",
        let(F.struct("front", segment_statements(F.col("front")).alias("statements"),
                     let(F.col("back"), slice_seeds).alias("seeds")),
            lambda s: F.struct(s["statements"].alias("statements"), s["seeds"].alias("seeds"),
                               backward_slice_mask(s["front"], s["statements"], s["seeds"]).alias("mask"))).alias("_s"))
    return sliced.select(*keep, "try_idx", "front", "back", "_s.statements", "_s.seeds", "_s.mask")


def split_methods(df: DataFrame, src_col: str = "src", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` + try_idx, front, back (A6 + A9 on the cleaned tokens)."""
    x = df.select(*keep, split_at_try(source_tokens(F.col(src_col))).alias("_p"))
    return x.select(*keep, "_p.try_idx", "_p.front", "_p.back")


def method_statements(df: DataFrame, src_col: str = "src", keep: tuple[str, ...] = ()) -> DataFrame:
    """A11 alone: ``keep`` + front, statements."""
    return split_methods(df, src_col, keep).select(
        *keep, "front", segment_statements(F.col("front")).alias("statements"))


def method_seeds(df: DataFrame, src_col: str = "src", keep: tuple[str, ...] = ()) -> DataFrame:
    """A12 alone: ``keep`` + seeds."""
    return split_methods(df, src_col, keep).select(*keep, let(F.col("back"), slice_seeds).alias("seeds"))


def quality_gate(mask: F.Column, front: F.Column) -> F.Column:
    """a slice is valid when more than one token is kept and lengths agree."""
    return (F.aggregate(mask, F.lit(0), lambda a, m: a + m) > 1) & (F.size(mask) == F.size(front))


def mask_sum(mask: F.Column) -> F.Column:
    return F.aggregate(mask, F.lit(0), lambda a, m: a + m)


def sliced_output(df: DataFrame) -> DataFrame:
    """Front/back as space-joined text, mask as JSON text (S8 layout)."""
    return df.withColumn("front", F.array_join("front", " ")) \
             .withColumn("back", F.array_join("back", " ")) \
             .withColumn("mask", json_int_list(F.col("mask")))


def explode_statements(df: DataFrame, keep: tuple[str, ...] = ("method_id",)) -> DataFrame:
    """One row per statement interval of ``front`` with its text."""
    x = df.select(*keep, "front", F.posexplode("statements").alias("stmt_no", "iv"))
    return x.select(*keep, "stmt_no", F.col("iv.s").alias("start"), F.col("iv.e").alias("end"),
                    F.array_join(F.slice("front", F.col("iv.s") + 1, F.col("iv.e") - F.col("iv.s") + 1),
                                 " ").alias("text"))


def split_quality(df: DataFrame, name: str = "slice_quality"):
    """F4 as a split: (good, quarantined, observation).

    The reference aborts the whole run on the first bad slice; here bad rows
    go to a quarantine frame with a reason.  The returned
    ``pyspark.sql.Observation`` collects the good/bad counts as a side effect
    of the first action on ``observed`` rows, with no extra job.
    """
    from pyspark.sql import Observation
    obs = Observation(name)
    valid = quality_gate(F.col("mask"), F.col("front"))
    flagged = df.withColumn("_valid", valid).observe(
        obs, F.sum(F.col("_valid").cast("long")).alias("good"),
        F.sum((~F.col("_valid")).cast("long")).alias("quarantined"))
    good = flagged.where("_valid").drop("_valid")
    bad = flagged.where(~F.col("_valid")).drop("_valid").withColumn(
        "reason", F.when(F.size("mask") != F.size("front"), "mask length differs")
                   .otherwise("at most one token kept"))
    return good, bad, obs
