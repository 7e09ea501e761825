"""Scoring with a user-supplied model object (L6) and an MLlib baseline.

L6 runs any model that maps a NumPy batch to class scores through
``predict_batch_udf``: the model is built once per Python worker and fed
Arrow batches, never one row at a time.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def weight_of(bucket, cls):
    """Example model weight for (id bucket, class): a small integer, 0 for the
    padding bucket.  Integer weights keep float32 sums exact."""
    return np.where(bucket == 0, 0, (bucket * 7919 + cls * 104729) % 101 - 50)


def hashed_linear_model(n_classes: int = 10, n_buckets: int = 4096) -> Callable:
    """A NumPy example model: class scores = sum of per-id weight rows.

    ``n_buckets`` is a parameter of the model: ids from ``n_buckets`` on share
    the weights of ``id % n_buckets``, and its multiples weigh nothing, like
    padding.  A caller who wants a weight per id passes more than the largest id.
    Returns ``make_predict_fn`` for ``predict_batch_udf``; the weight matrix
    is built inside each Python worker, once.
    """
    def make_predict_fn():
        b = np.arange(n_buckets)[:, None]
        c = np.arange(n_classes)[None, :]
        w = weight_of(b, c).astype(np.float32)

        def predict(ids: np.ndarray) -> np.ndarray:
            return w[ids.astype(np.int64) % n_buckets].sum(axis=1)
        return predict
    return make_predict_fn


def score_with_external_model(df: DataFrame, ids_col: str, length: int, make_predict_fn: Callable,
                              n_classes: int = 10, batch_size: int = 1024) -> DataFrame:
    """Add ``scores`` (array<float>) and ``class_id`` (argmax, lower id on ties)."""
    from pyspark.ml.functions import predict_batch_udf
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()),
                            batch_size=batch_size, input_tensor_shapes=[[length]])
    x = df.withColumn("scores", udf(F.col(ids_col).cast("array<float>")))
    best = F.array_position(x["scores"], F.array_max(x["scores"])) - 1
    return x.withColumn("class_id", best.cast("int"))


def fit_mllib_baseline(train: DataFrame, tokens: str = "tokens", label: str = "label",
                       num_features: int = 1 << 16, max_iter: int = 20):
    """HashingTF then multinomial LogisticRegression, fitted as one MLlib ``Pipeline``.

    ``num_features`` is a parameter of the model: tokens are hashed to so many
    features, and those that meet share a weight."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF
    tf = HashingTF(inputCol=tokens, outputCol="features", numFeatures=num_features)
    lr = LogisticRegression(featuresCol="features", labelCol=label, family="multinomial",
                            maxIter=max_iter, regParam=0.01)
    return Pipeline(stages=[tf, lr]).fit(train.withColumn(label, F.col(label).cast("double")))
