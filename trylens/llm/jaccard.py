"""Operator 3: exact Jaccard join on word shingles.

Two documents link when their sets of 5-word shingles overlap by 80 % or more.
Equal sets collapse to one class first.  The join then works in two steps.

1. *Leaders.*  Classes that share a min-hash key are compared with one class
   of that key only, another one for each key.  This joins large groups of near
   copies into few components without looking at their pairs.
2. *Tiles.*  Each class puts the rarest fifth of its shingles (its prefix
   under one global order) under their hashes; two sets that overlap by 80 %
   must share one.  Classes of one shingle form tiles, sorted and windowed by
   set size and cut into blocks when a shingle is common; pairs within a size
   window whose classes are not connected yet become candidates.

Candidates of both steps pass a bitmap test first: every class has a parity
bitmap as wide as its set is large, and the bits in which two of them differ
are at most the elements in which the sets differ, which bounds the overlap
from above.  What passes is decided by exact intersection of the sorted
shingle arrays.  Both steps together find a spanning set of all links, so the
components are exact.

The global order puts common shingles last.  It comes from a table of shingle
counts in ``2**DF_BITS`` hash buckets over all classes; the order changes the
work, never the result.

Defined cases: a text without words has set size 0 and is its own component;
a text of one to four words has its whole word sequence as its only shingle;
rows with equal sets are linked, repeated rows too; shingles are compared by
64-bit hashes; a null doc_id is never the smallest unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c
from .graph import components

WIDTH = 5
NUM, DEN = 80, 100        # link when DEN * overlap >= NUM * union
MIN_HASHES = 8
SIGNATURE_BITS = 512      # of the fixed-width bitmap compared inside a tile
DF_BITS = 19
TILE = 2048               # classes per block of a common shingle
_SALTS = np.random.default_rng(11).integers(1, 1 << 63, MIN_HASHES, dtype=np.uint64)
_OTHER = np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words = [t.lower().split() for t in texts]          # bytes: lower() changes A-Z only
    at = c.offsets_of(np.array([len(w) for w in words], dtype=np.int64))
    h = c.word_hashes([w for ws in words for w in ws])
    windows = c.window_hashes(h, width)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo >= width:
            out.append(np.unique(windows[lo:hi - width + 1]))
        else:
            out.append(c.window_hashes(h[lo:hi], hi - lo) if hi > lo else np.zeros(0, dtype=np.uint64))
    return out


def links(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact test on two sorted arrays of distinct shingles."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) * DEN < len(b) * NUM:
        return False
    at = np.searchsorted(b, a)
    same = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return DEN * same >= NUM * (len(a) + len(b) - same)


def parity_bitmap(s: np.ndarray, width: int | None = None) -> bytes:
    """One bit flip per shingle, in the next power of two >= len(s) bits (64 at least)."""
    width = width or max(64, 1 << (len(s) - 1).bit_length())
    slot = (s >> np.uint64(20)) & np.uint64(width - 1)
    return np.packbits((np.bincount(slot.astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def may_link(a: bytes, b: bytes, n: int, m: int) -> bool:
    """Upper bound from bit counts; ``n`` and ``m`` are the set sizes."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):                # slots are the low bits of a hash, so halves fold
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    differ = int(np.bitwise_count(x ^ y).sum())
    # overlap <= (n + m - differ) / 2 must reach NUM / (NUM + DEN) of n + m
    return (n + m - differ) * (NUM + DEN) >= 2 * NUM * (n + m)


def prefix_length(n: int) -> int:
    """Any set that links with one of size ``n`` shares one of so many first shingles."""
    return n - -(-n * NUM // DEN) + 1


# ---- steps -----------------------------------------------------------------------------

def set_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n, d1, d2): size and order-free 128-bit digest of each set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.slices(batches, "text"):
            sets = shingle_sets(c.text_bytes(b))
            d1 = np.array([c.mix64(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
            d2 = np.array([c.mix64(s ^ _OTHER).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
            ids, th = c.columns(b, ["doc_id", "th"])
            yield pa.RecordBatch.from_arrays(
                [ids, th, pa.array([len(s) for s in sets], pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))],
                names=["doc_id", "th", "n", "d1", "d2"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, "doc_id long, th long, n long, d1 long, d2 long")


def class_features(reps: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Per class (cls, n, keys, bitmap), and the shingle counts per hash bucket
    (a fixed 2**DF_BITS numbers, summed over tasks in two levels)."""
    buckets, piece = 1 << DF_BITS, 1 << 14

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int32(), pa.binary())
        names = ["cls", "n", "keys", "bitmap", "signature", "piece", "counts"]
        total = np.zeros(buckets, dtype=np.int64)
        for b in c.slices(batches, "text"):
            sets = shingle_sets(c.text_bytes(b))
            ids = c.columns(b, ["cls"])[0]
            if sets:
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - DF_BITS)).astype(np.int64), minlength=buckets)
            keys = [[int(c.mix64(s ^ salt).min().view(np.int64)) for salt in _SALTS] for s in sets]
            nothing = [None] * len(sets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip((ids, [len(s) for s in sets], keys, [parity_bitmap(s) for s in sets],
                                                 [parity_bitmap(s, SIGNATURE_BITS) for s in sets], nothing, nothing), kinds)], names=names)
        if total.any():
            parts = [total[i:i + piece].astype("<i8").tobytes() for i in range(0, buckets, piece)]
            none = [None] * len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip((none, none, none, none, none, range(len(parts)), parts), kinds)], names=names)

    rows = c.materialize(reps.mapInArrow(run, "cls long, n long, keys array<long>, bitmap binary, signature binary, "
                                  "piece int, counts binary")
                             .withColumn("task", F.spark_partition_id()), "jaccard-classes")

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(piece, dtype=np.int64)
        for x in pdf["counts"]:
            total += np.frombuffer(x, dtype="<i8")
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "counts": [total.astype("<i8").tobytes()]})

    counts = rows.where("piece is not null").select("piece", "counts", F.pmod("task", F.lit(64)).alias("lot"))
    counts = counts.groupBy("piece", "lot").applyInPandas(add, "piece int, counts binary") \
                   .groupBy("piece").applyInPandas(add, "piece int, counts binary")
    df = np.zeros(buckets, dtype=np.int64)
    for r in counts.collect():                                   # 2**DF_BITS numbers
        df[r["piece"] * piece:(r["piece"] + 1) * piece] = np.frombuffer(r["counts"], dtype="<i8")
    return rows.where("cls is not null").select("cls", "n", "keys", "bitmap", "signature"), df


def rarity_levels(df: np.ndarray) -> np.ndarray:
    """0 for buckets that hold what chance gives, 1, 2, ... per doubling beyond."""
    mean = max(1.0, float(df.mean()))
    usual = mean + 6.0 * mean ** 0.5
    return np.where(df > usual, np.floor(np.log2(np.maximum(df, 1) / usual)) + 1, 0).astype(np.uint8)


POSTING = ["token", "cls", "n", "place"]
_POSTING_TYPE = "token long, cls long, n int, place int"


def prefix_postings(reps: DataFrame, levels: np.ndarray) -> DataFrame:
    """(token, cls, n, place): the rarest shingles of every class and their
    places in its order."""
    order = reps.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.slices(batches, "text"):
            level = order.value
            tokens, counts, sizes = [], [], []
            for s in shingle_sets(c.text_bytes(b)):
                p = prefix_length(len(s))
                common = level[(s >> np.uint64(64 - DF_BITS)).astype(np.int64)]
                rare = s[common == 0]
                if len(rare) >= p:
                    first = rare[:p]                       # s is sorted by hash
                else:
                    first = s[np.argsort(common, kind="stable")[:p]]
                tokens.append(first)
                counts.append(p)
                sizes.append(len(s))
            if tokens:
                ids = c.columns(b, ["cls"])[0].to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(ids, counts)),
                     pa.array(np.repeat(np.array(sizes, dtype=np.int32), counts)),
                     pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in counts]))], names=POSTING)

    return reps.mapInArrow(run, _POSTING_TYPE)


def shared_postings(postings: DataFrame) -> DataFrame:
    """The postings whose shingle more than one class has.  Rows of a shingle
    come one after the other, so only the last row is held back."""
    rows = postings.repartition("token").sortWithinPartitions("token")

    def batch(x: np.ndarray) -> pa.RecordBatch:
        kinds = (np.int64, np.int64, np.int32, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x[:, j].astype(k)) for j, k in enumerate(kinds)], names=POSTING)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                       # last row and whether it is shared so far
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([a.to_numpy(zero_copy_only=False).astype(np.int64) for a in c.columns(b, POSTING)], axis=1)
            was = False
            if held is not None:
                x, was = np.concatenate([held[0], x]), held[1]
            same = x[1:, 0] == x[:-1, 0]
            shared = np.concatenate([[was], same]) | np.concatenate([same, [False]])
            held = (x[-1:], bool(shared[-1]))
            out = x[:-1][shared[:-1]]
            if len(out):
                yield batch(out)
        if held is not None and held[1]:
            yield batch(held[0])

    return rows.mapInArrow(run, _POSTING_TYPE)


def tile_pairs(x: np.ndarray, signatures: np.ndarray) -> np.ndarray:
    """Candidate pairs of one tile: rows (lo, hi, n, place, cls, comp, own),
    ascending n, with the rows' bitmap signatures.

    If the tile's shingle is the first one two linking sets share, what follows
    it in both must hold the rest of the overlap they need."""
    lo, hi, n, place, cls, comp, own = x.T
    last = np.searchsorted(n, n * DEN // NUM, side="right")      # sizes up to n / 0.8
    rest = n - place
    out = []
    for i in range(len(x) - 1):
        j = np.arange(i + 1, last[i])
        need = NUM * (n[i] + n[j])
        ok = (comp[j] != comp[i]) & ((NUM + DEN) * np.minimum(rest[i], rest[j]) >= need)
        if lo[0] != hi[0]:
            ok &= own[j] != own[i]
        j, need = j[ok], need[ok]
        if len(j):
            differ = np.bitwise_count(signatures[j] ^ signatures[i]).sum(axis=1)
            j = j[(n[i] + n[j] - differ) * (NUM + DEN) >= 2 * need]
        if len(j):
            out.append(np.stack([np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)


def tile_candidates(shared: DataFrame, comps: DataFrame, features: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of one tile, size window and different components.

    A shingle of more than ``TILE`` classes is dealt to pairs of blocks: each
    of its rows goes to every tile its block takes part in."""
    known = shared.join(comps, shared["cls"] == comps["node"], "left") \
                  .select(*POSTING, F.coalesce("component", "cls").alias("comp"))
    known = c.materialize(known, "jaccard-shared")
    # the smaller set of a pair has the shingle in its first ninth
    spans = known.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"),
                                       F.min(F.col("place") * (NUM + DEN) - F.col("n") * (DEN - NUM)).alias("early"),
                                       F.ceil(F.count("*") / TILE).cast("int").alias("blocks")) \
                 .where("x <> y and early <= 0")
    rows = known.join(spans.select("token", "blocks"), "token") \
                .join(features.select("cls", "signature"), "cls") \
                .withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks").cast("long")).cast("int")) \
                .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
                .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    names = ["token", "lo", "hi", "n", "place", "cls", "comp", "own"]
    tiles = rows.select(*names, "signature").repartition("token", "lo", "hi") \
                .sortWithinPartitions("token", "lo", "hi", "n", "cls")

    def emit(x: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        p = tile_pairs(x[:, 1:], s)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, k])) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = SIGNATURE_BITS // 64
        held, bits = np.zeros((0, 8), dtype=np.int64), np.zeros((0, words), dtype=np.uint64)
        for b in batches:
            cols = c.columns(b, [*names, "signature"])
            x = np.stack([a.to_numpy(zero_copy_only=False).astype(np.int64) for a in cols[:-1]], axis=1)
            s = np.frombuffer(b"".join(cols[-1].to_pylist()), dtype=np.uint64).reshape(-1, words)
            held, bits = np.concatenate([held, x]), np.concatenate([bits, s])
            edges = [0, *(np.flatnonzero((held[1:, :3] != held[:-1, :3]).any(axis=1)) + 1).tolist()]
            for lo, hi in zip(edges[:-1], edges[1:]):
                yield from emit(held[lo:hi], bits[lo:hi])
            held, bits = held[edges[-1]:], bits[edges[-1]:]
        if len(held):
            yield from emit(held, bits)

    return tiles.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, features: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: bitmap bound, then exact intersection."""
    bits = features.select("cls", "n", "bitmap")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, n, m = (v.to_pylist() for v in c.columns(b, ["bitmap_a", "bitmap_b", "n_a", "n_b"]))
            ok = [may_link(*v) for v in zip(x, y, n, m)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def sides(left: DataFrame, value: DataFrame, names: list[str]) -> DataFrame:
        for side in ("a", "b"):
            left = left.join(value.select(F.col("cls").alias(side), *[F.col(x).alias(f"{x}_{side}") for x in names]), side)
        return left

    near = sides(pairs, bits, ["n", "bitmap"]).where(
        (F.least("n_a", "n_b") * DEN >= F.greatest("n_a", "n_b") * NUM))
    near = c.materialize(near.mapInArrow(bound, "a long, b long"), "jaccard-near")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [c.columns(b, ["cls"])[0], pa.array([s.tobytes() for s in shingle_sets(c.text_bytes(b))], pa.binary())],
                names=["cls", "items"])

    needed = near.select(F.col("a").alias("cls")).union(near.select("b")).distinct()
    items = reps.join(needed, "cls", "left_semi").mapInArrow(arrays, "cls long, items binary")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (v.to_pylist() for v in c.columns(b, ["items_a", "items_b"]))
            ok = [links(np.frombuffer(u, dtype=np.uint64), np.frombuffer(v, dtype=np.uint64)) for u, v in zip(x, y)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return sides(near, items, ["items"]).mapInArrow(exact, "a long, b long")


def leader_pairs(features: DataFrame) -> DataFrame:
    """Each class with one class (by hash) of each of its min-hash keys."""
    keys = features.select("cls", F.posexplode("keys").alias("i", "key"))
    lead = keys.groupBy("i", "key").agg(F.min(F.struct(F.xxhash64("cls", "i").alias("h"), "cls")).alias("lead"),
                                        F.count("*").alias("n")).where("n > 1")
    pairs = keys.join(lead.select("i", "key", F.col("lead.cls").alias("l")), ["i", "key"]).where("cls <> l")
    return pairs.select(F.least("cls", "l").alias("a"), F.greatest("cls", "l").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n_shingles, component_id) per row of ``docs`` (doc_id, text);
    th is a hash of the text."""
    rows = c.materialize(set_digests(docs), "jaccard-rows")
    classes = rows.where("n > 0").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")).alias("one"))
    classes = c.materialize(classes.select("d1", "d2", "first_id", F.col("one.doc_id").alias("one_id"),
                                           F.col("one.th").alias("one_th"),
                                           F.monotonically_increasing_id().alias("cls")), "jaccard-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    reps = texts.join(classes.select("one_id", "one_th", "cls"),
                      F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("th") == F.col("one_th"))).select("cls", "text")
    reps = c.materialize(reps, "jaccard-texts")
    features, df = class_features(reps)

    first = c.materialize(verified(leader_pairs(features), features, reps), "jaccard-links")
    comps = c.materialize(components(first), "jaccard-comps")
    shared = shared_postings(prefix_postings(reps, rarity_levels(df)))
    found = c.materialize(verified(tile_candidates(shared, comps, features), features, reps), "jaccard-links")
    comps = components(first.union(found))

    named = classes.join(comps, classes["cls"] == comps["node"], "left") \
                   .select("d1", "d2", "first_id", F.coalesce("component", "cls").alias("comp"))
    named = c.materialize(named, "jaccard-named")
    smallest = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "comp").select("d1", "d2", "component_id")
    whole = rows.where("n > 0").join(named, ["d1", "d2"]).select("doc_id", "th", "n", "component_id")
    return whole.unionByName(rows.where("n = 0").select("doc_id", "th", "n", F.col("doc_id").alias("component_id"))) \
                .withColumnRenamed("n", "n_shingles")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one left of each component (its smallest doc_id, then
    text hash), with exactly the input's columns.  Repeated rows leave one."""
    rows = near_duplicates(docs)
    group = F.when(F.col("n_shingles") > 0, F.lit(0)).otherwise(F.col("th"))
    keep = (rows.groupBy("component_id", group.alias("g"), (F.col("n_shingles") > 0).alias("w"))
                .agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")).alias("k"))
                .select(F.col("k.doc_id").alias("__id"), F.col("k.th").alias("__th")))
    keep = c.materialize(keep, "jaccard-keep")
    x = docs.withColumn("__h", F.xxhash64("text"))
    x = x.join(keep.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")))
    one = Window.partitionBy("__id", "__th").orderBy(F.lit(1))
    return x.withColumn("__n", F.row_number().over(one)).where("__n = 1").select(*[docs[n] for n in docs.columns])
