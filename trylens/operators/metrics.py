"""Evaluation metrics (G4-G14) as grouped aggregations.

Every metric is a two-level aggregate at most: per-row/per-method partials
combined map-side, then a handful of global sums.  Nothing is collected to the
driver; results are one-row (or one-row-per-group) DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(num: Column, den: Column, empty: float = 0.0) -> Column:
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(empty))


def classification_accuracy(df: DataFrame, label: str = "label", pred: str = "pred",
                            group: tuple[str, ...] = ()) -> DataFrame:
    """Share of rows where prediction equals label."""
    return df.groupBy(*group).agg(
        F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def _per_class(df: DataFrame, label: str, pred: str, group: tuple[str, ...]) -> DataFrame:
    """Per class (over the union of seen labels and predictions): tp, support, predicted."""
    cells = df.groupBy(*group, label, pred).agg(F.count("*").alias("n"))
    as_true = cells.select(*group, F.col(label).alias("cls"), F.col("n").alias("support"),
                           F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0).alias("tp"),
                           F.lit(0).cast("long").alias("predicted"))
    as_pred = cells.select(*group, F.col(pred).alias("cls"), F.lit(0).cast("long").alias("support"),
                           F.lit(0).cast("long").alias("tp"), F.col("n").alias("predicted"))
    return as_true.unionByName(as_pred).groupBy(*group, "cls").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))


def _weighted_aggs() -> list[Column]:
    prec = _ratio(F.col("tp"), F.col("predicted"), 1.0)
    rec = _ratio(F.col("tp"), F.col("support"), 1.0)
    f1 = _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"), 1.0)
    total = F.sum("support")
    return [(F.sum(prec * F.col("support")) / total).alias("precision"),
            (F.sum(rec * F.col("support")) / total).alias("recall"),
            (F.sum(f1 * F.col("support")) / total).alias("f1")]


def weighted_precision_recall_f1(df: DataFrame, label: str = "label", pred: str = "pred",
                                 group: tuple[str, ...] = ()) -> DataFrame:
    """Support-weighted precision, recall and F1, ``zero_division=1``.

    A class that is never predicted has precision 1; its F1 is 2tp/(support +
    predicted) = 0.  MLlib's evaluator uses 0 there, so this is plain SQL.
    """
    return _per_class(df, label, pred, group).groupBy(*group).agg(*_weighted_aggs())


def epoch_validation_report(df: DataFrame, label: str = "label", pred: str = "pred",
                            epoch: str = "epoch") -> DataFrame:
    """Accuracy + weighted precision/recall/F1 per epoch, one row each.

    Accuracy is sum(tp) / sum(support) of the same per-class table, so one
    aggregation chain serves all four metrics."""
    pc = _per_class(df, label, pred, (epoch,))
    return pc.groupBy(epoch).agg((F.sum("tp") / F.sum("support")).alias("accuracy"), *_weighted_aggs())


def line_precision_recall_f1(lines: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Binary metrics, positive class 1, over all padded positions.

    Padding positions carry label 0 and prediction 0 (true negatives), so only
    real lines within the line limit contribute.  Empty denominators give 0.
    """
    tp = F.sum(((F.col(label) == 1) & (F.col(pred) == 1)).cast("long"))
    fp = F.sum(((F.col(label) == 0) & (F.col(pred) == 1)).cast("long"))
    fn = F.sum(((F.col(label) == 1) & (F.col(pred) == 0)).cast("long"))
    agg = lines.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return agg.select(
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def per_method_line_stats(lines: DataFrame, method: str = "method_id", line_no: str = "line_no",
                          label: str = "label", pred: str = "pred", line_limit: int = 50,
                          lines_count: str | None = None) -> DataFrame:
    """Per method over the first ``line_limit`` lines: correct, tp, positives, and the
    exact-match flags (G9 within ``lines_count`` when given, G10 over all positions)."""
    x = lines.where(F.col(line_no) <= line_limit)
    eq = F.col(label) == F.col(pred)
    within = (F.col(line_no) <= F.col(lines_count)) if lines_count else F.lit(True)
    return x.groupBy(method).agg(
        F.sum(eq.cast("long")).alias("correct"),
        F.count("*").alias("n_real"),
        F.sum(((F.col(label) == 1) & (F.col(pred) == 1)).cast("long")).alias("tp"),
        F.sum((F.col(label) == 1).cast("long")).alias("positives"),
        F.coalesce(F.bool_and(F.when(within, eq)), F.lit(True)).alias("match_within"),
        F.bool_and(eq).alias("match_all"))


def mean_method_line_accuracy(stats: DataFrame, line_limit: int = 50) -> DataFrame:
    """Mean over methods of accuracy over all ``line_limit`` positions."""
    pad = F.lit(line_limit) - F.col("n_real")
    return stats.agg(F.avg((F.col("correct") + pad) / line_limit).alias("mean_line_accuracy"))


def mean_method_line_recall(stats: DataFrame) -> DataFrame:
    """Mean over methods of line recall; a method with no positives scores 1."""
    return stats.agg(F.avg(_ratio(F.col("tp"), F.col("positives"), 1.0)).alias("mean_line_recall"))


def exact_match_rate(stats: DataFrame, flag: str = "match_within") -> DataFrame:
    """Share of methods whose compared labels all match; hits and total."""
    return stats.agg(F.avg(F.col(flag).cast("double")).alias("rate"),
                     F.sum(F.col(flag).cast("long")).alias("hits"),
                     F.count("*").alias("total"))


def topn_accuracy(ranks: DataFrame, ns: tuple[int, ...] = (1, 2, 3, 5, 10),
                  rank_col: str = "true_rank") -> DataFrame:
    """Share of rows whose true class is among the n best, all n in one pass."""
    return ranks.agg(*[F.avg((F.col(rank_col) <= n).cast("double")).alias(f"top{n}") for n in ns])


def cross_entropy(df: DataFrame, id_col: str = "id", score: str = "logit",
                  class_col: str = "class_id", label: str = "label") -> DataFrame:
    """Per-row ``-log softmax[label]`` = logsumexp(x) - x[label], max-shifted."""
    per_row = df.groupBy(id_col).agg(
        F.first(label).alias(label), F.max(score).alias("_m"),
        F.collect_list(F.struct(F.col(score).alias("s"), F.col(class_col).alias("c"))).alias("_sc"))
    lse = F.log(F.aggregate("_sc", F.lit(0.0), lambda a, x: a + F.exp(x["s"] - F.col("_m")))) + F.col("_m")
    own = F.try_element_at(F.filter("_sc", lambda x: x["c"] == F.col(label)), F.lit(1))["s"]
    return per_row.select(id_col, (lse - own).alias("ce"))


def mean_cross_entropy(ce: DataFrame, batch_col: str = "batch") -> DataFrame:
    """Per-row mean, and the reference's value: the sum of per-batch means
    divided by the number of rows."""
    per_batch = ce.groupBy(batch_col).agg(F.avg("ce").alias("bm"), F.sum("ce").alias("bs"),
                                          F.count("*").alias("bn"))
    return per_batch.agg((F.sum("bs") / F.sum("bn")).alias("mean_ce"),
                         (F.sum("bm") / F.sum("bn")).alias("ref_ce"))


def training_window_rollup(log: DataFrame, window: int = 100) -> DataFrame:
    """Per epoch, every ``window`` batches: mean loss and accuracy in percent.

    A trailing window shorter than ``window`` batches is not reported.
    """
    w = log.groupBy("epoch", F.floor(F.col("batch") / window).cast("int").alias("win")).agg(
        F.sum("loss").alias("_loss"), F.sum("correct").alias("_c"), F.sum("total").alias("_t"),
        F.count("*").alias("_n"))
    return w.where(F.col("_n") == window).select(
        "epoch", "win", (F.col("_loss") / window).alias("avg_loss"),
        (100.0 * F.col("_c") / F.col("_t")).alias("accuracy_pct"))
