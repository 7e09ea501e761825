"""Operator 2: quality classifier, hashed word n-gram logistic regression.

Features of a text: its tokens (runs of word bytes, runs of other non-space
bytes) and pairs of neighbouring tokens, hashed to ``2**BITS`` slots; a token
repeated at once hashes to one shared "same again" slot.  Values are
log(1 + count), scaled to length 1, so long texts weigh no more than short
ones.

Training uses follow-the-regularised-leader updates on at most about
``max_train`` labelled rows (a documented bound on the fit, chosen by a hash of
the id), dealt into ``SHARDS`` parts that are trained apart and averaged by
Spark.  The model is at most 2**BITS weights.  Scoring is one scan: a sparse
dot product per text.

Defined cases: null or empty text has no features and scores by the bias
alone; duplicate label rows count once (the largest label); null labels are
not learned from; without labelled rows every score is 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

BITS = 18
SHARDS = 4
MAX_TRAIN = 16000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 8.0, 1.0, 0.0, 1e-5
_TOKEN = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^\x00-\x20A-Za-z0-9_\x80-\xff]+")
_SAME = np.uint64(0x5A5A5A5A12345678)
BIAS = 1 << BITS           # one slot beyond the hashed ones

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of a chunk: (text index, slot, value), sorted by text."""
    tokens = [_TOKEN.findall(t) for t in texts]
    counts = np.array([len(t) for t in tokens], dtype=np.int64)
    h = c.word_hashes([w for t in tokens for w in t])
    doc = np.repeat(np.arange(len(texts)), counts)
    pair = c.window_hashes(h, 2)
    if len(pair):
        pair = np.where(h[1:] == h[:-1], _SAME, pair)
        inside = doc[1:] == doc[:-1]
        h, doc = np.concatenate([h, pair[inside]]), np.concatenate([doc, doc[1:][inside]])
    slot = (c.mix64(h) >> np.uint64(64 - BITS)).astype(np.int64)
    cell, n = np.unique(doc << BITS | slot, return_counts=True)
    row, slot = cell >> BITS, cell & ((1 << BITS) - 1)
    value = np.log1p(n)
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=len(texts)))
    return row, slot, value / norm[row]


def train_ftrl(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes of FTRL-proximal updates, one text at a time."""
    row, slot, value = features(texts)
    at = np.searchsorted(row, np.arange(len(texts) + 1))
    z = np.zeros(BIAS + 1)
    n = np.zeros(BIAS + 1)

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(z[i]) <= L1, 0.0, w)

    for _ in range(epochs):
        for k, y in enumerate(labels):
            i = np.append(slot[at[k]:at[k + 1]], BIAS)
            x = np.append(value[at[k]:at[k + 1]], 1.0)
            w = weights(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(BIAS + 1))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> np.ndarray:
    """Model weights from ``docs`` (doc_id, text) and ``labels`` (doc_id, label)."""
    labels = labels.where(F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    total = labels.count()
    scale = 1 << 30
    share = scale if total <= max_train else scale * max_train // total
    # bounded by max_train, so it may be sent to every task
    chosen = F.broadcast(labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < share))
    sample = docs.join(chosen, "doc_id").select(
        F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARDS)).alias("shard"), "doc_id", "text", "label")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"])       # the same order on every run
        order = np.argsort(c.mix64(pdf["doc_id"].to_numpy().astype(np.uint64)), kind="stable")
        pdf = pdf.iloc[order]
        w = train_ftrl([(t or "").encode("utf-8") for t in pdf["text"]], pdf["label"].to_numpy(dtype=float))
        slot = np.flatnonzero(w)
        return pd.DataFrame({"slot": np.append(slot, -1), "w": np.append(w[slot], 1.0) * len(pdf)})

    parts = sample.groupBy("shard").applyInPandas(run, "slot long, w double")
    model = parts.groupBy("slot").agg(F.sum("w").alias("w")).toPandas()     # at most 2**BITS + 2 rows
    weights = np.zeros(BIAS + 1)
    if len(model):
        n = float(model.loc[model["slot"] == -1, "w"].iloc[0])
        model = model[model["slot"] >= 0]
        weights[model["slot"].to_numpy()] = model["w"].to_numpy() / n
    return weights


def scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    row, slot, value = features(texts)
    dot = np.bincount(row, weights=weights[slot] * value, minlength=len(texts)) + weights[BIAS]
    return 1.0 / (1.0 + np.exp(-np.clip(dot, -35, 35)))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Score every row of ``docs`` (doc_id, held_out, text)."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.slices(batches, "text"):
            s = scores(c.text_bytes(b), model.value)
            ids, held = c.columns(b, ["doc_id", "held_out"])
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "held_out": held, "score": s,
                                              "predicted": (s >= 0.5).astype(np.int32)})

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, SCHEMA)


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality",
                   max_train: int = MAX_TRAIN) -> DataFrame:
    """Fit on labelled rows that are not held out, then score every row.  A
    null id counts as held out."""
    held = F.coalesce(F.pmod(c.id_crc(), F.lit(3)) == 1, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    weights = fit(rows.where(~F.col("held_out")).select("doc_id", "text"), y, max_train)
    return score(rows, weights)
