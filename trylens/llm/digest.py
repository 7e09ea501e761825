"""Operator 6: quartile bucket digests of documents.

Every byte position adds three byte triplets (itself with two of the next four
bytes) to 128 hash buckets.  The digest holds one byte for the length on a
log scale, one byte for the ratios of the quartiles, and two bits per bucket:
the quartile its count lies in.  The difference of two digests is the sum of
the bucket steps (three steps count six) and of the header steps; likeness is
``1 - min(difference, BOUND) / BOUND``.

Equal texts have equal digests.  Defined cases: null text is the empty text
(all counts zero); rows of one doc_id follow each other by text hash; a null
doc_id comes first; the successor of the last row is the first, so a single
row follows itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

BUCKETS = 128
BOUND = 256
_STEP = np.array([0, 1, 2, 6], dtype=np.int64)
_TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 4))

SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def bucket_counts(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    total = np.zeros(BUCKETS, dtype=np.int64)
    for salt, (i, j, k) in enumerate(_TRIPLETS):
        n = len(a) - k
        if n > 0:
            x = a[i:i + n] | (a[j:j + n] << 8) | (a[k:k + n] << 16)
            x += np.uint32(salt << 24)
            x *= np.uint32(0x9E3779B1)
            x ^= x >> 15
            x *= np.uint32(0x85EBCA77)
            x >>= 25
            total += np.bincount(x, minlength=BUCKETS)
    return total


def digest(data: bytes) -> np.ndarray:
    """uint8 vector: length code, two ratio codes, one quartile code a bucket."""
    n = bucket_counts(data)
    q1, q2, q3 = np.sort(n)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (n > q1).astype(np.uint8) + (n > q2) + (n > q3)
    length = min(255, int(round(np.log1p(len(data)) / np.log(1.2))))
    top = max(1, int(q3))
    return np.concatenate([np.array([length, 15 * q1 // top, 15 * q2 // top], dtype=np.uint8), codes.astype(np.uint8)])


def to_hex(d: np.ndarray) -> str:
    quads = d[3:].reshape(-1, 4)
    body = quads[:, 0] << 6 | quads[:, 1] << 4 | quads[:, 2] << 2 | quads[:, 3]
    return f"{d[0]:02x}{d[1]:x}{d[2]:x}" + body.astype(np.uint8).tobytes().hex()


def difference(a: np.ndarray, b: np.ndarray) -> int:
    step = np.abs(a.astype(np.int64) - b)
    header = step[:3]
    return int(_STEP[step[3:]].sum() + np.where(header > 1, 4 * header, header).sum())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1.0 - min(difference(a, b), BOUND) / BOUND


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as much of the beginning of the next text."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


def with_successors(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Cut the documents into ranges of ascending id and give each range a last
    row that is the first document of the next one.

    Columns: part, tail (1 for that extra row), key, th, doc_id, text.  Only
    the bounds and first ids of the ranges (``ranges`` numbers) reach the
    driver; each text is shuffled once."""
    spark = docs.sparkSession
    low = -(1 << 63)
    key = F.coalesce(F.col("doc_id"), F.lit(low))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", key)
    n = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = [i / n for i in range(1, n)]
    bounds = sorted(set(x.agg(F.percentile_approx("key", share, 10 * n).alias("q")).first()["q"] or [])) if n > 1 else []
    part = F.lit(0)
    if bounds:
        # the number of bounds below the key: bounds are few, sorted and literal
        part = F.expr(f"size(filter(array({','.join(f'{b}L' for b in bounds)}), b -> b < key))")
    x = x.withColumn("part", part)
    firsts = [(r["part"], r["k"]) for r in x.groupBy("part").agg(F.min("key").alias("k")).orderBy("part").collect()]
    if not firsts:
        return x.withColumn("tail", F.lit(0)).withColumn("th", F.xxhash64("text")) \
                .select("part", "tail", "key", "th", "doc_id", "text")
    after = [(firsts[(i + 1) % len(firsts)][1], firsts[i][0]) for i in range(len(firsts))]
    heads = spark.createDataFrame(after, "k long, into int")
    th = F.xxhash64("text")
    tails = (x.select("key", "doc_id", "text").join(F.broadcast(heads), F.col("key") == F.col("k"))
              .groupBy("into", "key").agg(F.min(F.struct(th.alias("th"), "doc_id", "text")).alias("h"))
              .select(F.col("into").alias("part"), F.lit(1).alias("tail"), "key", "h.th", "h.doc_id", "h.text"))
    return x.select("part", F.lit(0).alias("tail"), "key", th.alias("th"), "doc_id", "text").unionByName(tails)


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text) with ``SCHEMA``."""
    rows = with_successors(docs.select("doc_id", "text"), ranges).repartition("part") \
        .sortWithinPartitions("part", "tail", "key", "th").select("part", "tail", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None                     # (part, id, text, digest) waiting for its successor
        for b in c.slices(batches, "text"):
            out: list[list] = [[] for _ in range(7)]
            part, tail, ids, texts = (x.to_pylist() for x in c.columns(b, ["part", "tail", "doc_id", "text"]))
            for p, is_tail, i, t in zip(part, tail, ids, texts):
                t = t or ""
                d = digest(t.encode("utf-8"))
                if last is not None and last[0] == p:
                    _, i0, t0, d0 = last
                    e = edited(t0, t).encode("utf-8")
                    de = digest(e)
                    for col, v in zip(out, (i0, len(t0), hashlib.sha256(e).hexdigest(), to_hex(d0), to_hex(de),
                                            likeness(d0, de), likeness(d0, d))):
                        col.append(v)
                last = None if is_tail else (p, i, t, d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(),
                                                      pa.float64(), pa.float64()))],
                names=[f.split()[0] for f in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)
