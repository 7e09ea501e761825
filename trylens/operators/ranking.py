"""Scores, ranks and orderings (M1, M4, K1-K4).

Class scores are kept in long form ``(id, class_id, score)``.  Per-row work
(softmax, top-k, argmax) is a window or an aggregate partitioned by ``id``:
one shuffle on the row id, never a global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import with_position


def clamp_scores(score: Column) -> Column:
    """M4: negative scores -> 0 (the ReLU on the type model's output)."""
    return F.greatest(score, F.lit(0.0))


def softmax_scores(df: DataFrame, id_col: str = "id", score_col: str = "logit",
                   out: str = "prob", order: tuple = ()) -> DataFrame:
    """M1: per-row softmax over the class scores, max-shifted for stability.

    ``order`` sorts the classes of a row for a later window, so that both share
    one sort."""
    w = Window.partitionBy(id_col)
    if order:
        w = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shifted = F.exp(F.col(score_col) - F.max(score_col).over(w))
    x = df.withColumn("_e", shifted)
    return x.withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def argmax_class(df: DataFrame, id_col: str = "id", score_col: str = "logit",
                 class_col: str = "class_id") -> DataFrame:
    """K2: best class per row; ties go to the lower class id."""
    return df.groupBy(id_col).agg(
        F.max_by(class_col, F.struct(F.col(score_col), -F.col(class_col))).alias(class_col))


def topk_classes(df: DataFrame, k: int, id_col: str = "id", score_col: str = "logit",
                 class_col: str = "class_id") -> DataFrame:
    """K1: softmax of clamped scores, the ``k`` best classes per row.

    Rank 1 is the best; equal probabilities rank the lower class id first.
    """
    clamped = df.withColumn("_s", clamp_scores(F.col(score_col)))
    order = (F.desc("_s"), F.asc(class_col))
    # one sort for the softmax and the rank: a task holds its rows once
    probs = softmax_scores(clamped, id_col, "_s", "prob", order)
    w = Window.partitionBy(id_col).orderBy(*order)
    ranked = probs.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k).drop("_s")


def true_class_rank(df: DataFrame, id_col: str = "id", score_col: str = "logit",
                    class_col: str = "class_id", label_col: str = "label") -> DataFrame:
    """Rank of the true class per row (1 = best), clamped scores, lower id wins ties.

    One aggregate per row id: the label's score is found with ``max_by`` and the
    better classes are counted in the same pass (no self-join).
    """
    s = clamp_scores(F.col(score_col))
    per_row = df.groupBy(id_col).agg(
        F.first(label_col).alias(label_col),
        F.collect_list(F.struct(s.alias("s"), F.col(class_col).alias("c"))).alias("_sc"))
    return per_row.select(
        id_col, label_col,
        _rank_in(F.col("_sc"), F.col(label_col)).alias("true_rank"))


def _rank_in(scores: Column, label: Column) -> Column:
    from ..functions.arrays import let
    own = F.filter(scores, lambda x: x["c"] == label)
    return let(F.try_element_at(own, F.lit(1))["s"], lambda t: F.size(F.filter(
        scores, lambda x: (x["s"] > t) | ((x["s"] == t) & (x["c"] < label)))) + 1)


def seeded_order_key(id_col: Column, seed: int = 42, epoch: Column | int = 0) -> Column:
    """K3: a shuffle key stable under re-partitioning: md5 of ``id:seed:epoch``."""
    ep = epoch if isinstance(epoch, Column) else F.lit(epoch)
    return F.md5(F.concat_ws(":", id_col.cast("string"), F.lit(str(seed)), ep.cast("string")))


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = 42, epoch: int = 0,
                   out: str = "pos") -> DataFrame:
    """K3: a seeded random order, as 0-based positions."""
    keyed = df.withColumn("_k", seeded_order_key(F.col(id_col), seed, epoch))
    return with_position(keyed, [F.col("_k"), F.col(id_col)], out).drop("_k")


def assign_batches(df: DataFrame, order: list, size: int, out: str = "batch") -> DataFrame:
    """K4: consecutive groups of ``size`` rows in ``order``."""
    pos = with_position(df, order, "_pos")
    return pos.withColumn(out, F.floor(F.col("_pos") / size).cast("long")).drop("_pos")
