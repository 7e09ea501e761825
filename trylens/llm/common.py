"""Helpers shared by the operators of this subpackage.

Words everywhere are the runs ``[^\\x20\\x09-\\x0D]+``: exactly what
``bytes.split()`` gives on UTF-8 bytes.  Word and shingle identity is a 64-bit
hash computed with numpy over the bytes of a whole chunk of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.util import materialize  # noqa: F401  (re-exported)

# The word pattern as a regex literal for SQL engines and Java.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

# Documents are handled in chunks of about this many bytes inside a task; a
# single longer document is a chunk of its own (texts are never cut).
CHUNK_BYTES = 1 << 20

_U = np.uint64
_RAND = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds), element-wise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _power_table(n: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64, kept between calls."""
    global _powers
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        grown = np.full(size, _BASE, dtype=np.uint64)
        grown[0] = 1
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(grown)
    return _powers


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One 64-bit hash per word, for all words of a chunk at once."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    buf = np.frombuffer(b"".join(words), dtype=np.uint8)
    starts = np.cumsum(lens) - lens
    at = np.arange(len(buf), dtype=np.int64) - np.repeat(starts, lens)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_RAND[buf] * _power_table(int(lens.max()))[at], starts)
        return mix64(h ^ (lens.astype(np.uint64) * _BASE))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of ``n`` consecutive word hashes (len(h)-n+1 of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * _U(0xD6E8FEB86659FD93) + h[j:j + m]
        return mix64(out)


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    col = batch.column(batch.schema.get_field_index(column))
    return [b or b"" for b in col.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows holding about ``max_bytes`` of text."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        block = (np.cumsum(size) - size) // max_bytes
        cuts = np.flatnonzero(np.diff(block)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def offsets_of(counts: np.ndarray) -> np.ndarray:
    """[0, c0, c0+c1, ...]: where each document's items begin and end."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def columns(batch: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def id_crc(col: str = "doc_id"):
    """crc32 of the id written as text: what the hold-out rules are defined on."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def rank_within(df: DataFrame, key: str, order: str, out: str, buckets: int = 1024) -> DataFrame:
    """0-based rank of each row inside its ``key``, by a non-negative 62-bit
    ``order`` value (ties in any order), without one task per key.

    Rows of a key are cut into ``buckets`` equal ranges of the order value;
    counts per (key, bucket) give offsets (at most ``buckets`` rows per key)
    and only the rank inside one (key, bucket) uses a window.
    """
    shift = 62 - (buckets - 1).bit_length()
    x = df.withColumn("__b", F.shiftright(F.col(order), shift).cast("int"))
    sizes = x.groupBy(key, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(key, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(key, "__b").orderBy(order)
    x = x.withColumn("__r", F.row_number().over(inside) - 1)
    return (x.join(base, [key, "__b"]).withColumn(out, (F.col("__off") + F.col("__r")).cast("long"))
             .drop("__b", "__r", "__off"))
