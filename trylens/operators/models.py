"""Count-based classifiers fit and applied with joins and aggregations (L1-L4).

Multinomial naive Bayes with add-alpha smoothing:

* fit: ``groupBy(class, token)`` of counts (taken in Arrow batches and combined
  map-side, so a very common token costs one row per partition);
  class totals and the vocabulary size come from the same counts.
* model: ``(class_id, token, log_lik)`` for seen pairs, plus per class a
  ``prior`` and an ``unseen`` log likelihood.
* score: ``prior + n_known * unseen + sum(log_lik - unseen)`` over the
  document's known tokens.

Scores are rounded to 6 digits before the argmax; ties go to the lower class.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.streams import head_sums, read_lists, token_counts

ALPHA = 1.0
MAX_CLASSES = 1000        # a class table beyond this is refused, not broadcast
HEAD_BYTES = 16 << 20     # of a model's tokens, so much is broadcast; the others are joined
MAX_STEPS = 10_000        # steps of frequency whose bytes the driver reads


def prefixed_tokens(*parts: tuple[str, Column]) -> Column:
    """Concatenate token arrays, each token prefixed (``f:``, ``b:``, ...)."""
    def prefix(p: str):
        return lambda t: F.concat(F.lit(p), t)
    return F.concat(*[F.transform(c, prefix(p)) for p, c in parts])


def fit_naive_bayes(docs: DataFrame, label: str = "label", tokens: str | tuple[str, ...] = "tokens",
                    alpha: float = ALPHA, read=read_lists) -> DataFrame:
    """L1/L3 fit: one row per (class_id, token) seen in training, with the
    class's prior and unseen log likelihood repeated on each row.  A class
    whose documents hold no tokens has one row, without token, for its prior.

    One pass over ``docs``: tokens are counted in Arrow batches, every document as
    one marker row beside them, and the batches' counts are summed.  ``read`` (a
    reader of ``streams``) makes the token lists from the columns ``tokens`` there;
    with lists of lines, ``label`` holds a list of classes.  The vocabulary size is computed as an action; the per-class table
    has one row per class and is broadcast after a check of its rows.
    """
    from .util import materialize
    given = docs.select(F.col(label).alias("class_id"), *_columns(tokens))
    kind = given.schema["class_id"].dataType
    schema = T.StructType([T.StructField("class_id", kind.elementType if isinstance(kind, T.ArrayType) else kind),
                           T.StructField("doc", T.BooleanType()), T.StructField("token", T.StringType()), T.StructField("n", T.LongType())])
    rows = given.mapInArrow(token_counts(read), schema)
    seen = materialize(rows.groupBy("class_id", "doc", "token").agg(F.sum("n").alias("n")), "nb_counts")
    counts = seen.where("not doc").select("class_id", "token", "n")
    v = counts.select("token").distinct().count()
    totals = counts.groupBy("class_id").agg(F.sum("n").alias("n_c"))
    docs_per = seen.where("doc").select("class_id", F.col("n").alias("d_c"))
    n_docs = F.sum("d_c").over(Window.partitionBy(F.lit(0)))   # over the class table only
    n_c = F.coalesce("n_c", F.lit(0))
    classes = materialize(docs_per.join(totals, "class_id", "left").select(
        "class_id", n_c.alias("n_c"), F.log(F.col("d_c") / n_docs).alias("prior"),
        F.log(F.lit(alpha) / (n_c + F.lit(alpha * v))).alias("unseen")), "nb_classes")
    _check_classes(classes.limit(MAX_CLASSES + 1).count())
    bare = classes.where("n_c = 0").select("class_id", F.lit(None).cast("string").alias("token"),
                                           F.lit(None).cast("double").alias("log_lik"), "prior", "unseen")
    return counts.join(F.broadcast(classes), "class_id").select(
        "class_id", "token",
        F.log((F.col("n") + alpha) / (F.col("n_c") + F.lit(alpha * v))).alias("log_lik"),
        "prior", "unseen").unionByName(bare)


def _columns(names: str | tuple[str, ...]) -> list[Column]:
    return [F.col(c) for c in ((names,) if isinstance(names, str) else names)]


def _check_classes(n: int) -> None:
    if n > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")


@dataclass(frozen=True)
class PreparedModel:
    """A model ready to score: its classes, the weights of its frequent tokens
    (broadcast), and the other tokens, one row each with a column per class (None:
    there are no others).  Prepared once, it serves any number of batches."""
    classes: tuple
    head: Broadcast
    tail: DataFrame | None


def prepare_model(model: DataFrame, write: bool = True, head_bytes: int | None = None) -> PreparedModel:
    """The pivoted form of a fitted model; ``write``: kept as a table, as several
    jobs read it.  At most ``MAX_CLASSES`` rows of classes and ``head_bytes``
    (``HEAD_BYTES``) of the most frequent tokens reach the driver."""
    from .util import materialize
    classes = model.select("class_id", "prior", "unseen").distinct().orderBy("class_id").limit(MAX_CLASSES + 1).collect()
    _check_classes(len(classes))
    weights = [f"d{k}" for k in range(len(classes))]
    wide = model.where("token is not null").groupBy("token").agg(*[
        F.sum(F.when(F.col("class_id") == r["class_id"], F.col("log_lik") - F.col("unseen"))).alias(w)
        for w, r in zip(weights, classes)])
    wide = materialize(wide, "nb_wide") if write else wide
    # weights are logarithms of counts: a token's step says how frequent it is
    most = F.greatest(F.lit(None).cast("double"), *weights) if weights else F.lit(0.0)
    wide = wide.withColumn("_step", F.coalesce(F.floor(most * 2), F.lit(-1 << 30)))
    sizes = wide.groupBy("_step").agg(F.sum(F.octet_length("token") + 16 + 8 * len(weights)).alias("b"))
    steps = sizes.orderBy(F.desc("_step")).limit(MAX_STEPS + 1).collect()
    limit, end, whole = HEAD_BYTES if head_bytes is None else head_bytes, None, len(steps) <= MAX_STEPS
    for r in steps[:MAX_STEPS]:
        limit -= r["b"]
        if limit < 0:
            whole = False
            break
        end = r["_step"]
    head = wide.where(F.lit(False) if end is None else F.col("_step") >= end).drop("_step").toArrow()
    shared = model.sparkSession.sparkContext.broadcast((head["token"].to_pylist(), [
        pc.fill_null(head[w], 0.0).to_numpy() for w in weights]))
    tail = None if whole else wide.where(F.lit(True) if end is None else F.col("_step") < end).drop("_step")
    return PreparedModel(tuple(classes), shared, tail)


def class_scores(docs: DataFrame, model: DataFrame | PreparedModel, key: str = "id", tokens: str | tuple[str, ...] = "tokens",
                 read=read_lists, place: str | None = None) -> DataFrame:
    """L2/L4 score: (key, scores array<struct<class_id, score>>, class_id = argmax).

    ``read`` as in ``fit_naive_bayes``; with lists of lines, rows are told apart by
    ``place``, the line's number from 1 on, a column beside ``key``.

    The model is pivoted to one row per token with a column per class
    (``prepare_model``).  Its frequent tokens are summed from a document's token
    list in Arrow batches; only the tokens that these do not hold are exploded and
    joined with the others, and one aggregation per key adds both.  The classes
    are a literal array; every class score and the argmax are computed inside the
    row (lower class id wins ties).
    """
    from .util import materialize
    prepared = model if isinstance(model, PreparedModel) else prepare_model(model)
    classes, tail = prepared.classes, prepared.tail
    given = docs.select(F.col(key).alias("key"), *_columns(tokens))
    sums = [f"s{k}" for k in range(len(classes))]
    schema = T.StructType([given.schema["key"], T.StructField("place", T.IntegerType()), T.StructField("n_known", T.LongType()),
                           *[T.StructField(s, T.DoubleType()) for s in sums], T.StructField("rare", T.ArrayType(T.StringType()))])
    x = given.mapInArrow(head_sums(prepared.head, len(classes), read), schema)
    if tail is not None:
        x = materialize(x, "nb_head_sums")
        more = x.select("key", "place", F.explode("rare").alias("token")).join(tail, "token").select(
            "key", "place", F.lit(1).cast("long").alias("n_known"),
            *[F.coalesce(f"d{k}", F.lit(0.0)).alias(s) for k, s in enumerate(sums)])
        x = x.drop("rare").unionByName(more)
    keys = [F.col("key").alias(key), *([F.col("place").alias(place)] if place else [])]
    per_key = x.groupBy(*keys).agg(F.sum("n_known").alias("n_known"), *[F.sum(s).alias(s) for s in sums])

    def one(k, r):
        sc = F.lit(r["prior"]) + F.col("n_known") * F.lit(r["unseen"]) + F.col(f"s{k}")
        return F.struct(F.lit(r["class_id"]).alias("class_id"), F.round(sc, 6).alias("score"))
    scores = F.array(*[one(k, r) for k, r in enumerate(classes)])
    x = per_key.select(key, *([place] if place else []), scores.alias("scores"))
    best = F.array_max(F.transform("scores", lambda c: F.struct(
        c["score"].alias("s"), (-c["class_id"]).alias("neg"), c["class_id"].alias("c"))))
    return x.withColumn("class_id", best["c"])
