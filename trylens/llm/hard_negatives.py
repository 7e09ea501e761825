"""Operator 13: hard negatives by slot-decomposed selection.

Every anchor's positives are its highest-scoring rows of its own label.  The
negatives of a positive come from a window of scores below the positive's, and
the windows of one anchor overlap.  The positives' upper limits cut the scores
into disjoint slots, highest first; each task keeps the top k rows of a slot
for the anchors it holds, a group limit merges the tasks, and a window's answer
is the first k of its own slot and the slots below it, one after another
(suffixes of the slots, highest score first), as far as its lower limit.  So no row is scored
again for each positive, and an anchor never has more than k rows a slot and task.

Anchors meet all rows in cells: a block of at most ``ANCHORS`` anchors and a
block of about ``ROWS`` rows.  A task streams the rows of a cell past its
anchors as matrix products, so its memory is one block of anchors, one Arrow
batch and k rows a slot.

Defined cases: rows with a null id, label, vector or component or a non-finite
component take no part, nor do rows whose integer vector is longer than
``2**24`` (scores stay in 64 bits); rows that repeat id, label and vector are one
row, rows of one id that differ otherwise are rows of their own, in any order; a
shorter vector counts as filled up with zeros; an anchor without positives, and
a positive without negatives in its window, give no rows; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95        # percent of the positive's score
ANCHORS = 8192            # anchors of a cell
ROWS = 1 << 18            # rows of a cell, about
LEAST = 1 << 11           # rows that are worth a cell of their own
_SCORES = 1 << 22         # scores held at a time
_END = 1 << 62


def integer_vectors(df: DataFrame) -> DataFrame:
    """(uid, id, label, v): the rows that take part, each numbered once."""
    x = df.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("l"),
                  F.col("embedding").alias("e"))
    finite = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = x.where("id is not null and l is not null and e is not null").where(finite)
    x = x.withColumn("f", F.transform("e", lambda v: F.floor(v.cast("double") * 256).cast("double")))
    x = x.where(F.aggregate("f", F.lit(0.0), lambda s, v: s + v * v) < float(1 << 48))
    x = x.select("id", F.when(F.col("id") % 7 == 0, (F.col("l") + 1) % 10).otherwise(F.col("l")).alias("label"),
                 F.transform("f", lambda v: v.cast("int")).alias("v"))
    return c.materialize(x.distinct().withColumn("uid", F.monotonically_increasing_id()), "negatives-rows")


def matrix(col: pa.Array) -> np.ndarray:
    """A list column as an integer matrix, short rows filled with zeros."""
    size = np.diff(col.offsets.to_numpy())
    wide = int(size.max()) if len(size) else 0
    out = np.zeros((len(size), wide), dtype=np.int64)
    out[np.arange(wide)[None, :] < size[:, None]] = col.flatten().to_numpy(zero_copy_only=False)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in the narrowest type that holds every partial sum."""
    wide = min(a.shape[1], b.shape[1])
    a, b = a[:, :wide], b[:, :wide]
    bound = wide * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return a.astype(kind) @ b.T.astype(kind)


def top_rows(anchor, slot, score, row_id, uid, k: int) -> tuple[np.ndarray, ...]:
    """The first ``k`` of each (anchor, slot) by descending score, then id."""
    order = np.lexsort((uid, row_id, -score, slot, anchor))
    anchor, slot, score, row_id, uid = (x[order] for x in (anchor, slot, score, row_id, uid))
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (slot[1:] != slot[:-1])
    first = np.flatnonzero(new)
    rank = np.arange(len(anchor)) - first[np.cumsum(new) - 1] if len(first) else first
    keep = rank < k
    return tuple(x[keep] for x in (anchor, slot, score, row_id, uid))


class Cell:
    """The anchors of a cell and the best rows of their slots so far."""

    def __init__(self, k: int, same: bool):
        self.k, self.same, self.blocks = k, same, []
        self.best = tuple(np.zeros(0, dtype=np.int64) for _ in range(5))

    def add_anchors(self, b: pa.RecordBatch) -> None:
        uid, ids, label, least = (x.to_numpy(zero_copy_only=False) for x in c.columns(b, ["uid", "id", "label", "least"]))
        v, limits = c.columns(b, ["v", "limits"])
        size = np.diff(limits.offsets.to_numpy())
        upper = np.full((len(size), int(size.max())), -_END, dtype=np.int64)
        upper[np.arange(upper.shape[1])[None, :] < size[:, None]] = limits.flatten().to_numpy(zero_copy_only=False)
        self.blocks.append((uid, ids, label, least, upper, matrix(v)))

    def add_rows(self, b: pa.RecordBatch) -> None:
        uid, ids, label = (x.to_numpy(zero_copy_only=False) for x in c.columns(b, ["uid", "id", "label"]))
        rows = matrix(c.columns(b, ["v"])[0])
        found = [self.best]
        for block in self.blocks:
            # rows of one label meet only anchors of it where labels must agree
            of = [(np.flatnonzero(block[2] == x), np.flatnonzero(label == x)) for x in np.unique(block[2])] if self.same \
                else [(np.arange(len(block[0])), np.arange(len(uid)))]
            for at, r in of:
                step = max(1, _SCORES // max(1, len(r)))
                for lo in range(0, len(at) if len(r) else 0, step):
                    found.append(self._candidates([x[at[lo:lo + step]] for x in block], uid[r], ids[r], label[r], rows[r]))
        self.best = top_rows(*(np.concatenate(x) for x in zip(*found)), self.k)

    def _candidates(self, block, uid, ids, label, rows) -> tuple[np.ndarray, ...]:
        a_uid, a_id, a_label, least, upper, v = block
        score = products(v, rows)
        fits = (score >= least[:, None]) & (score <= upper[:, :1])
        fits &= (a_id[:, None] != ids[None, :]) if self.same else (a_label[:, None] != label[None, :])
        i, j = np.nonzero(fits)
        s = score[i, j].astype(np.int64)
        sure = (s >= least[i]) & (s <= upper[i, 0])         # limits beyond a float's whole numbers
        i, j, s = i[sure], j[sure], s[sure]
        slot = (upper[i] >= s[:, None]).sum(axis=1) - 1
        return top_rows(a_uid[i], slot, s, ids[j], uid[j], self.k)

    def result(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in self.best], names=["anchor", "slot", "score", "id", "uid"])


def top_per_slot(anchors: DataFrame, rows: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor, slot, score, id, uid): per anchor and slot the first ``k`` rows
    of the same (or of another) label.

    ``anchors``: uid, id, label, v, ``limits`` (upper limits of the slots,
    descending) and ``least`` (scores below take no part)."""
    n, a = rows.count(), anchors.count()
    parallel = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    g = max(1, -(-a // ANCHORS))
    r = max(1, -(-n // ROWS), min(-(-parallel // g), -(-n // LEAST)))
    here = lambda many, salt: F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(many)).cast("long")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    left = anchors.select((here(g, 1) * r).alias("own"), every(r).alias("other"), F.lit(0).alias("kind"),
                          "uid", "id", "label", "v", "limits", "least")
    right = rows.select(here(r, 2).alias("own"), every(g).alias("g"), F.lit(1).alias("kind"),
                        "uid", "id", "label", "v", F.lit(None).cast("array<bigint>").alias("limits"),
                        F.lit(None).cast("long").alias("least"))
    right = right.withColumn("other", F.col("g") * r).drop("g")
    cells = left.unionByName(right).withColumn("cell", F.col("own") + F.col("other")).drop("own", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell = None, None
        for b in batches:
            key, kind = (x.to_numpy(zero_copy_only=False) for x in c.columns(b, ["cell", "kind"]))
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if lo == hi:
                    continue
                if key[lo] != at:
                    if cell is not None:
                        yield cell.result()
                    at, cell = key[lo], Cell(k, same)
                part = b.slice(lo, hi - lo)
                cell.add_rows(part) if kind[lo] else cell.add_anchors(part)
        if cell is not None:
            yield cell.result()

    best = cells.repartition("cell").sortWithinPartitions("cell", "kind") \
                .mapInArrow(run, "anchor long, slot long, score long, id long, uid long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id", "uid")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def hard_negatives(embeddings: DataFrame, every: int = 50) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score);
    anchors are the rows whose id is divisible by ``every``."""
    rows = integer_vectors(embeddings)
    anchors = c.materialize(rows.where(F.col("id") % every == 0), "negatives-anchors")
    whole = anchors.withColumn("limits", F.array(F.lit(_END))).withColumn("least", F.lit(-_END))
    near = top_per_slot(whole, rows, POSITIVES, True)
    # exact integer bounds of the window, for negative scores too
    near = near.withColumn("upper", F.expr(f"(score * {HIGH} - pmod(score * {HIGH}, 100)) div 100")) \
               .withColumn("lower", F.expr(f"-((score * -{LOW} - pmod(score * -{LOW}, 100)) div 100)")) \
               .where("lower <= upper")
    positives = c.materialize(near.select("anchor", F.col("id").alias("positive_id"), F.col("uid").alias("positive_uid"),
                                          F.col("score").alias("positive_score"), "lower", "upper"), "negatives-positives")
    slots = positives.groupBy("anchor").agg(F.sort_array(F.collect_set("upper"), asc=False).alias("limits"),
                                            F.min("lower").alias("least"))
    cut = c.materialize(anchors.join(slots, F.col("uid") == F.col("anchor")).drop("anchor"), "negatives-slots")
    best = top_per_slot(cut, rows, NEGATIVES, False)
    # slots ascend as scores descend, so each suffix of slots is in score order already
    found = best.groupBy("anchor").agg(F.sort_array(F.collect_list(
        F.struct("slot", (-F.col("score")).alias("minus"), "id", "uid"))).alias("found"))
    x = positives.join(cut.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"), "limits"), "anchor") \
                 .join(found, "anchor")
    x = x.withColumn("own", F.array_position("limits", F.col("upper")) - 1)
    x = x.withColumn("first", F.slice(F.filter("found", lambda z: z["slot"] >= F.col("own")), 1, NEGATIVES))
    x = x.withColumn("first", F.filter("first", lambda z: -z["minus"] >= F.col("lower")))
    return x.select("anchor_id", "positive_id", F.posexplode("first").alias("place", "z"), "positive_score") \
            .select("anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"),
                    F.col("z.id").alias("negative_id"), "positive_score", (-F.col("z.minus")).alias("negative_score"))


ORACLE = f"""
WITH r AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (
  SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INT AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
   AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
