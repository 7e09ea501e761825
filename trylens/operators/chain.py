"""A linear chain over the lines of a method (L3, L4 with sequence context).

Transition counts come from the corpus in one aggregation; line scores come
from any line model; the best label sequence of a method is a Viterbi fold over
its array of line scores, inside the row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.folds import scan

MAX_CLASSES = 64        # the transition table is classes x classes


def fit_transitions(sequences: DataFrame, labels: str = "labels") -> DataFrame:
    """(prev, next, n): how often label ``next`` follows ``prev`` (null: begins a
    sequence) in the arrays of ``labels``.  Null labels are left out."""
    x = sequences.select(F.array_compact(labels).alias("l")).where(F.size("l") > 0)
    none = F.array(F.lit(None).cast("int"))
    pairs = F.arrays_zip(F.concat(none, F.slice("l", 1, F.size("l") - 1)).alias("prev"), F.col("l").alias("next"))
    return x.select(F.explode(pairs).alias("p")).groupBy("p.prev", "p.next").agg(F.count("*").alias("n"))


def chain_weights(transitions: DataFrame, classes: list[int], alpha: float = 1.0) -> tuple[list[float], list[list[float]]]:
    """(first, following): smoothed log probabilities to 6 digits, in the order
    of ``classes``.  At most ``MAX_CLASSES`` squared numbers reach the driver."""
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    rows = transitions.where(F.col("next").isin(classes) & (F.col("prev").isNull() | F.col("prev").isin(classes))).collect()
    counts = {(r["prev"], r["next"]): r["n"] for r in rows}

    def row(prev):
        total = sum(counts.get((prev, c), 0) for c in classes)
        return [round(math.log((counts.get((prev, c), 0) + alpha) / (total + alpha * len(classes))), 6) for c in classes]
    return row(None), [row(c) for c in classes]


def best_path(scores: Column, first: list[float], following: list[list[float]]) -> Column:
    """array<int>: the places (in the order of the weights) of the labels of the
    best sequence; ``scores`` holds one array of class scores a line.

    Ties go to the smaller place, from the last line backwards."""
    numbers = lambda v: F.array(*[F.lit(float(x)) for x in v])
    begin, table = numbers(first), F.array(*[numbers(r) for r in following])

    def step(state, emit):
        def cell(e, j):
            came = F.array_max(F.transform(state, lambda s, i: F.struct(
                (s + F.element_at(F.element_at(table, i + 1), j + 1)).alias("v"), (-i).alias("k"))))
            return let(F.when(F.size(state) == 0, F.struct(F.element_at(begin, j + 1).alias("v"), F.lit(0).alias("k"))).otherwise(came),
                       lambda c: F.struct((c["v"] + e).alias("v"), (-c["k"]).alias("k")))
        return let(F.transform(emit, cell), lambda cells: F.struct(
            F.transform(cells, lambda c: c["v"]).alias("s"), F.transform(cells, lambda c: c["k"]).alias("o")))

    def back(forward):
        last = F.array_max(F.transform(forward["s"], lambda s, i: F.struct(s.alias("v"), (-i).alias("k"))))
        follow = lambda at, came: F.struct(F.element_at(came, at + 1).alias("s"), at.alias("o"))
        return F.reverse(scan(F.reverse(forward["o"]), F.coalesce(-last["k"], F.lit(0)), follow, "int")["o"])

    return let(scan(scores, F.array().cast("array<double>"), step, "array<int>"), back)


def score_sequences(line_scores: DataFrame, transitions: DataFrame, key: str = "method_id", place: str = "line_no",
                    scores: str = "scores") -> DataFrame:
    """(key, place, class_id) by the best sequence of each key's lines.

    ``line_scores``: one row a line with ``scores`` array<struct<class_id, score>>
    as ``models.class_scores`` gives them.  Lines meet by key once; a method's
    lines are one row from there on."""
    classes = [r["class_id"] for r in line_scores.select(F.explode(F.transform(scores, lambda s: s["class_id"])).alias("class_id"))
                                                 .distinct().orderBy("class_id").limit(MAX_CLASSES + 1).collect()]
    if not classes:
        return line_scores.select(key, place, F.lit(None).cast("int").alias("class_id"))
    first, following = chain_weights(transitions, classes)
    of = lambda c: F.filter(scores, lambda s: s["class_id"] == c)[0]["score"]
    x = line_scores.select(key, F.struct(F.col(place).alias("p"), F.array(*[of(c) for c in classes]).alias("e")).alias("z"))
    x = x.groupBy(key).agg(F.array_sort(F.collect_list("z")).alias("z"))
    path = best_path(F.transform("z", lambda z: z["e"]), first, following)
    x = x.select(key, F.explode(F.arrays_zip(F.transform("z", lambda z: z["p"]).alias("p"), path.alias("k"))).alias("r"))
    names = F.array(*[F.lit(c) for c in classes])
    return x.select(key, F.col("r.p").alias(place), F.element_at(names, F.col("r.k") + 1).alias("class_id"))
