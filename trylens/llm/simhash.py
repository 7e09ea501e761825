"""Operator 11: SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has bit i set when more than half of the hashes of its
3-word shingles (repeats included) have it.  Equal fingerprints collapse to one
class; two classes link when they differ in at most ``RADIUS`` bits.

Fingerprints are compared exactly, tile by tile, with numpy exclusive-or and
bit counts.  The bits of a fingerprint are cut into equal parts, and a tile
holds fingerprints whose parts have the same population counts.  Two
fingerprints differ in at least as many bits as the counts of their parts
differ, so only tiles whose counts differ by ``RADIUS`` in all meet; every
other pair of tiles is skipped.  More parts give smaller tiles and fewer
comparisons, and never change a result: ``parts_for`` picks them by the number
of classes.  A tile holds at most ``TILE`` fingerprints; a common count vector
has several tiles.

A tile pair yields a spanning set of its links, not the links themselves, so a
large group of near copies gives rows in proportion to its fingerprints.

Defined cases: a null text or one without words has fingerprint zero and links
like any other; fewer than three words are one shingle; repeated rows stay and
link; a null doc_id is never the smallest unless all are null; an empty table
gives an empty result; very long texts are hashed block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c
from .graph import components

WIDTH = 3
SEED = 42
RADIUS = 2
TILE = 512
_BITS = 64
_BLOCK = 1 << 16          # shingles hashed at a time
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The 64-bit majority fingerprint of a UTF-8 text."""
    raw = np.frombuffer(text.lower(), dtype=np.uint8)       # bytes: lower() changes A-Z only
    gap = _SPACE[raw]
    keep = ~gap
    keep[1:] |= ~gap[:-1]                                   # one space after each word
    line = np.where(gap, np.uint8(0x20), raw)[keep].tobytes().strip()
    if not line:
        return 0
    ends = np.append(np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 0x20), len(line))
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(ends))
    starts, ends = starts[:len(starts) - width + 1], ends[width - 1:]
    votes = np.zeros(_BITS, dtype=np.int64)
    for lo in range(0, len(starts), _BLOCK):
        spans = zip(starts[lo:lo + _BLOCK].tolist(), ends[lo:lo + _BLOCK].tolist())
        h = np.array([xxhash.xxh64_intdigest(line[s:e], SEED) for s, e in spans], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row per input row, the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.slices(batches):
            fps = np.array([fingerprint(t) for t in c.text_bytes(b)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*c.columns(b, ["doc_id"]), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def parts_for(classes: int) -> int:
    """Parts of a fingerprint: as many as make comparing cheaper than moving tiles."""
    return 2 if classes < 1 << 13 else 4 if classes < 1 << 19 else 8 if classes < 1 << 26 else 16


def part_counts(fp: Column, parts: int) -> Column:
    """The population counts of the parts as one number, each in a digit with
    room for ``RADIUS`` on both sides."""
    wide = _BITS // parts
    mask = (1 << wide) - 1 if wide < _BITS else -1
    digits = [F.bit_count(F.shiftrightunsigned(fp, k * wide).bitwiseAND(F.lit(mask).cast("long"))) for k in range(parts)]
    return sum(((d + RADIUS).cast("long") * F.lit(_base(parts) ** k) for k, d in enumerate(digits)), F.lit(0).cast("long"))


def _base(parts: int) -> int:
    return _BITS // parts + 1 + 2 * RADIUS


def count_steps(parts: int) -> list[int]:
    """Differences of ``part_counts`` within the radius; of two opposite ones, one."""
    reach = [{(): 0}]
    for _ in range(parts):
        reach.append({(*v, d): used + abs(d) for v, used in reach[-1].items()
                      for d in range(-RADIUS, RADIUS + 1) if used + abs(d) <= RADIUS})
    return sorted({abs(sum(d * _base(parts) ** k for k, d in enumerate(v))) for v in reach[-1]})


def tiles(classes: DataFrame, parts: int) -> DataFrame:
    """(tile, counts, fps): fingerprints of equal counts, at most ``TILE`` together.

    The rows are sorted by count and fingerprint, so a common count is spread
    over several tasks like any other stretch of the order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(counts: np.ndarray, fps: np.ndarray, last: bool):
            new = np.flatnonzero(np.diff(counts)) + 1
            edges = [0, *new.tolist(), len(counts)]
            bounds = [lo for a, z in zip(edges, edges[1:]) for lo in range(a, z, TILE)] + [len(counts)]
            if not last:                        # the last tile may go on in the next batch
                bounds = bounds[:-1]
            done = bounds[-1]
            out = pa.RecordBatch.from_arrays(
                [pa.array(counts[bounds[:-1]]), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(fps[:done]))],
                names=["counts", "fps"])
            return out, counts[done:], fps[done:]

        counts, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            k, f = (x.to_numpy(zero_copy_only=False) for x in c.columns(b, ["counts", "fp"]))
            counts, fps = np.concatenate([counts, k]), np.concatenate([fps, f])
            if len(counts):
                out, counts, fps = cut(counts, fps, False)
                yield out
        if len(counts):
            yield cut(counts, fps, True)[0]

    rows = classes.select(part_counts(F.col("fp"), parts).alias("counts"), "fp").orderBy("counts", "fp")
    cut = rows.mapInArrow(run, "counts long, fps array<long>")
    return c.materialize(cut.withColumn("tile", F.monotonically_increasing_id()), "simhash-tiles")


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its group) for the links a-b between ``n`` nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def tile_links(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links between two tiles (``same``: within one)."""
    differ = a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]      # unsigned: all 64 bits count
    near = np.bitwise_count(differ) <= RADIUS
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    if len(i) > 1:
        i, j = spanning(i, j if same else len(a) + j, len(a) if same else len(a) + len(b))
        all_ = a if same else np.concatenate([a, b])
        return all_[i], all_[j]
    return a[i], b[j]


def links(tiled: DataFrame, parts: int) -> DataFrame:
    """(a, b): links of a spanning set between the tiles that may hold any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            (a, a_at), (b, b_at) = ((x.flatten().to_numpy(zero_copy_only=False), x.offsets.to_numpy() - x.offsets[0].as_py())
                                    for x in c.columns(rows, ["a", "b"]))
            same = rows.column(rows.schema.get_field_index("same")).to_numpy(zero_copy_only=False)
            for k in range(rows.num_rows):
                x, y = tile_links(a[a_at[k]:a_at[k + 1]], b[b_at[k]:b_at[k + 1]], same[k])
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    steps = F.array(*[F.lit(d).cast("long") for d in count_steps(parts)])
    left = tiled.select(F.col("tile").alias("tile_a"), F.col("fps").alias("a"), "counts", F.explode(steps).alias("step")) \
                .select("tile_a", "a", "step", (F.col("counts") + F.col("step")).alias("counts"))
    right = tiled.select(F.col("tile").alias("tile_b"), F.col("fps").alias("b"), "counts")
    pairs = left.join(right, "counts").where("step > 0 or tile_a <= tile_b")
    return pairs.select("a", "b", (F.col("tile_a") == F.col("tile_b")).alias("same")).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    marked = c.materialize(fingerprints(docs), "simhash-docs")
    classes = c.materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    parts = parts or parts_for(classes.count())
    groups = components(c.materialize(links(tiles(classes, parts), parts), "simhash-links"))
    firsts = classes.join(groups, F.col("fp") == F.col("node"), "left") \
                    .select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    ids = firsts.where("component is not null").groupBy("component").agg(F.min("first_id").alias("component_id"))
    of = firsts.join(ids, "component").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
