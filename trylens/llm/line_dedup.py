"""Operator 7: delete repeated runs of lines with a distributed suffix array.

Every document is the sequence of its lines with a word (line IDs are 64-bit
hashes).  Stretches of lines that all occur more than once hold every repeated
run; only their positions enter the suffix array.  It is built by prefix
doubling, two doublings a round: ranks of the first 4**k lines of each suffix
are put beside the ranks 4**k, 2 * 4**k and 3 * 4**k lines further on, and the
distinct rows of ranks are sorted and numbered by Spark, until a round tells no
more suffixes apart.  Longest common prefixes of neighbours in suffix order then give, for
each position, the longest run of lines that also occurs earlier in the corpus
(order: doc_id, text hash, line).  Runs of at least ``min_words`` words are
deleted at every place but the first.

Defined cases: a null text stays null; lines without a word are never deleted
on their own; a document all of whose lines go has an empty text, and
``dedup_lines`` leaves such documents out; rows repeated with the same doc_id
and text are one document; a null doc_id comes first; runs may overlap their
own copy inside one document (the first copy stays).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

MIN_WORDS = 50
_FAN = 4              # a round makes ranks of so many times as many lines
_STEP = 64            # lines compared at a time when measuring common prefixes


def ordered_ids(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number the rows in ``order`` (a total order); ids ascend but leave gaps
    between partitions.  Written once, so the ids are fixed."""
    return c.materialize(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()), f"lines-{name}")


def gapless(rows: DataFrame, column: str, ids: DataFrame, name: str) -> DataFrame:
    """``rows`` with the values of ``column``, which ``ordered_ids`` gave as
    ``name`` of ``ids``, closed up to 0, 1, 2, ...

    The upper bits of such an id are its partition, the lower 33 its place
    there; the offsets are one row per partition."""
    sizes = ids.groupBy(F.shiftright(name, 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    place = F.col(column).bitwiseAND((1 << 33) - 1)
    return (rows.join(F.broadcast(offsets), F.shiftright(column, 33) == F.col("_part"))
                .withColumn(column, F.col("_off") + place).drop("_part", "_off"))


def line_sequences(docs: DataFrame) -> DataFrame:
    """(doc_id, th, at, ids, words): original index, hash and word count of each
    line with a word; one row per document with such a line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.slices(batches, "text"):
            ids, th = c.columns(b, ["doc_id", "th"])
            at, words, lines, counts = [], [], [], []
            for t in c.text_bytes(b):
                own = [(i, x, len(x.split())) for i, x in enumerate(t.split(b"\n"))]
                own = [z for z in own if z[2]]
                counts.append(len(own))
                at.append([z[0] for z in own])
                words.append([z[2] for z in own])
                lines += [z[1] for z in own]
            ends = c.offsets_of(np.array(counts, dtype=np.int64)).astype(np.int32)
            hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(c.word_hashes(lines).view(np.int64)))
            out = pa.RecordBatch.from_arrays(
                [ids, th, pa.array(at, pa.list_(pa.int32())), hashes, pa.array(words, pa.list_(pa.int32()))],
                names=["doc_id", "th", "at", "ids", "words"])
            yield out.filter(pa.array(np.array(counts) > 0))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    seqs = rows.mapInArrow(run, "doc_id long, th long, at array<int>, ids array<long>, words array<int>")
    return seqs.dropDuplicates(["doc_id", "th"])


def repeated_stretches(seqs: DataFrame, min_words: int) -> DataFrame:
    """(seg, doc_id, th, start, ids, words): maximal stretches of lines that all
    occur more than once and hold ``min_words`` words; ``seg`` ascends in
    document order, with gaps."""
    lines = seqs.select("doc_id", "th", F.posexplode("ids").alias("i", "h"))
    often = lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    hits = lines.join(often, "h").groupBy("doc_id", "th").agg(F.collect_list("i").alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_id, th, ids, words, hit = (x.to_pylist() for x in c.columns(b, ["doc_id", "th", "ids", "words", "hits"]))
            out: list[list] = [[] for _ in range(5)]
            for d, t, x, w, at in zip(doc_id, th, ids, words, hit):
                at = np.sort(np.array(at, dtype=np.int64))
                for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                    lo, hi = int(part[0]), int(part[-1]) + 1
                    if sum(w[lo:hi]) >= min_words:
                        for col, v in zip(out, (d, t, lo, x[lo:hi], w[lo:hi])):
                            col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()),
                                                      pa.list_(pa.int32())))],
                names=["doc_id", "th", "start", "ids", "words"])

    same = (F.col("s.doc_id").eqNullSafe(F.col("q.doc_id"))) & (F.col("s.th") == F.col("q.th"))
    joined = seqs.alias("s").join(hits.alias("q"), same).select("s.doc_id", "s.th", "s.ids", "s.words", "q.hits")
    parts = joined.mapInArrow(run, "doc_id long, th long, start int, ids array<long>, words array<int>")
    return ordered_ids(parts, [F.col("doc_id").asc_nulls_first(), F.col("th"), F.col("start")], "seg")


def suffix_array(segs: DataFrame) -> DataFrame:
    """(seg, i, rank): the rank of each position's suffix among the distinct
    suffixes of the stretches; equal suffixes share a rank."""
    longest = segs.agg(F.max(F.size("ids"))).first()[0] or 0
    parts = [f"r{k}" for k in range(_FAN)]
    # any order of line IDs will do; null: the stretch ends, sorts first
    ahead = [F.slice("ids", k + 1, F.size("ids")) for k in range(_FAN)]
    lines = F.posexplode(F.arrays_zip(*[x.alias(r) for x, r in zip(ahead, parts)])).alias("i", "x")
    blocks = segs.select("seg", lines).select("seg", "i", "x.*")
    width, known = 1, 0
    while True:
        blocks = c.materialize(blocks, "lines-blocks")
        named = ordered_ids(blocks.select(*parts).distinct(), [F.col(r).asc_nulls_first() for r in parts], "name")
        same = reduce(and_, (blocks[r].eqNullSafe(named[r]) for r in parts))
        ranks = blocks.join(named, same).select("seg", "i", F.col("name").alias("rank"))
        width *= _FAN
        told = named.count()
        # a round that splits no class leaves every later one nothing to split
        if width >= longest or told == known:
            return c.materialize(gapless(ranks, "rank", named, "name"), "lines-rank")
        known = told
        further = Window.partitionBy("seg").orderBy("i")           # the lines of one stretch
        blocks = ranks.select("seg", "i", *[F.lead("rank", k * width).over(further).alias(r) for k, r in enumerate(parts)])


def neighbour_prefixes(suffixes: DataFrame, segs: DataFrame) -> DataFrame:
    """(rank, lcp) for each distinct suffix (rank, seg, i) that shares lines with
    the one before it, comparing ``_STEP`` lines at a time."""
    before = suffixes.select((F.col("rank") + 1).alias("rank"), F.col("seg").alias("seg_b"), F.col("i").alias("i_b"))
    todo = suffixes.join(before, "rank").withColumn("lcp", F.lit(0))
    done = None
    while True:
        a = segs.select("seg", F.col("ids").alias("ids_a"))
        b = segs.select(F.col("seg").alias("seg_b"), F.col("ids").alias("ids_b"))
        part = lambda ids, i: F.slice(ids, F.col(i) + F.col("lcp") + 1, _STEP)
        x = todo.join(a, "seg").withColumn("x", part("ids_a", "i")).drop("ids_a") \
                .join(b, "seg_b").withColumn("y", part("ids_b", "i_b")).drop("ids_b")
        equal = F.zip_with("x", "y", lambda u, v: F.coalesce(u == v, F.lit(False)))
        first = F.array_position(equal, False)
        x = x.withColumn("got", F.when(first > 0, first - 1).otherwise(F.size(equal)).cast("int"))
        x = c.materialize(x.select("rank", "seg", "i", "seg_b", "i_b", (F.col("lcp") + F.col("got")).alias("lcp"),
                                   (F.col("got") == _STEP).alias("more")), "lines-lcp")
        end = x.where("not more").select("rank", "lcp")
        done = end if done is None else done.unionByName(end)
        todo = x.where("more").drop("more")
        if not todo.limit(1).count():
            return done


def earlier_runs(segs: DataFrame, min_words: int) -> DataFrame:
    """(seg, i, run): positions whose first ``run`` lines also occur earlier."""
    ranks = suffix_array(segs)
    firsts = c.materialize(ranks.groupBy("rank").agg(F.min(F.struct("seg", "i")).alias("p"))
                                .select("rank", "p.seg", "p.i"), "lines-suffixes")
    lcp = neighbour_prefixes(firsts, segs)
    lines = segs.select("seg", F.posexplode("ids").alias("i", "h"))
    rows = (firsts.join(lcp, "rank", "left").join(lines, ["seg", "i"])
                  .select("h", "rank", "seg", "i", F.coalesce("lcp", F.lit(0)).alias("lcp"))
                  .repartition("h").sortWithinPartitions("h", "rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A stack of suffixes with ascending places; a suffix leaves it when the
        # next one in order lies earlier, with the longer of its two prefixes.
        stack: list[list] = []          # [seg, i, prefix shared with the one below]
        h0 = None
        out: list[list] = [[], [], []]

        def settle(top, right):
            n = max(top[2], right)
            if n:
                for col, v in zip(out, (top[0], top[1], n)):
                    col.append(v)

        def drain():
            while stack:
                settle(stack.pop(), 0)

        def batch():
            r = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int32()))],
                                           names=["seg", "i", "run"])
            for col in out:
                col.clear()
            return r

        for b in batches:
            for h, _, seg, i, shared in zip(*(x.to_pylist() for x in c.columns(b, ["h", "rank", "seg", "i", "lcp"]))):
                if h != h0 or not shared:
                    drain()
                    h0, shared = h, 0
                while stack and (stack[-1][0], stack[-1][1]) > (seg, i):
                    top = stack.pop()
                    settle(top, shared)
                    shared = min(shared, top[2])
                stack.append([seg, i, shared if stack else 0])
            yield batch()
        drain()
        yield batch()

    own = rows.mapInArrow(run, "seg long, i int, run int")
    # positions whose whole rest occurs earlier
    size = segs.select("seg", F.size("ids").alias("size"))
    rest = (ranks.join(firsts.select("rank", F.col("seg").alias("s"), F.col("i").alias("j")), "rank")
                 .where("seg <> s or i <> j").join(size, "seg")
                 .select("seg", "i", (F.col("size") - F.col("i")).cast("int").alias("run")))
    return own.unionByName(rest)


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, gone): original indexes of the lines to delete."""
    seqs = c.materialize(line_sequences(docs), "lines-seqs")
    segs = repeated_stretches(seqs, min_words)
    runs = c.materialize(earlier_runs(segs, min_words), "lines-runs")
    words = F.aggregate(F.slice("words", F.col("i") + 1, F.col("run")), F.lit(0), lambda s, x: s + x)
    good = (runs.join(segs.select("seg", "words"), "seg").where(words >= min_words)
                .groupBy("seg").agg(F.collect_list(F.struct("i", "run")).alias("runs")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_id, th, start, runs_, at = (x.to_pylist() for x in c.columns(b, ["doc_id", "th", "start", "runs", "at"]))
            gone = []
            for s, rs, a in zip(start, runs_, at):
                hit = np.zeros(len(a) + 1, dtype=np.int64)
                for r in rs:
                    hit[s + r["i"]] += 1
                    hit[s + r["i"] + r["run"]] -= 1
                gone.append([a[k] for k in np.flatnonzero(np.cumsum(hit)[:-1] > 0)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_id, pa.int64()), pa.array(th, pa.int64()), pa.array(gone, pa.list_(pa.int32()))],
                names=["doc_id", "th", "gone"])

    same = (F.col("g.doc_id").eqNullSafe(F.col("s.doc_id"))) & (F.col("g.th") == F.col("s.th"))
    where = good.join(segs.select("seg", "doc_id", "th", "start"), "seg").alias("g").join(seqs.alias("s"), same) \
                .select("g.doc_id", "g.th", "g.start", "g.runs", "s.at")
    parts = where.mapInArrow(run, "doc_id long, th long, gone array<int>")
    return parts.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("gone")).alias("gone"))


def cleaned(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The input's columns with the repeated runs cut out of ``text``, plus
    ``__lines`` and ``__gone`` (lines with a word before, lines deleted)."""
    gone = c.materialize(deletions(docs, min_words), "lines-gone") \
        .select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("gone").alias("__del"))
    # the deletions grow with the corpus, so they are never broadcast
    x = docs.join(gone.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th")), "left")
    x = x.select(*[docs[n] for n in docs.columns], "__del")
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.slices(batches, "text"):
            texts, dels = (v.to_pylist() for v in c.columns(b, ["text", "__del"]))
            lines, cut = [], []
            for k, (t, d) in enumerate(zip(texts, dels)):
                parts = (t or "").split("\n")
                full = [i for i, p in enumerate(parts) if p.encode("utf-8").split()]
                lines.append(len(full))
                cut.append(len(d or ()))
                if d:
                    d = set(d)
                    left = [p for i, p in enumerate(parts) if i not in d]
                    texts[k] = "\n".join(left) if len(d) < len(full) else ""
            arrays = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(lines, pa.int64()), pa.array(cut, pa.int64())],
                                             names=[*names, "__lines", "__gone"])

    schema = T.StructType([*docs.schema.fields, T.StructField("__lines", T.LongType()), T.StructField("__gone", T.LongType())])
    return x.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents without their repeated runs; documents that lose every line
    are left out.  Exactly the input's columns."""
    return cleaned(docs, min_words).where("__gone = 0 or __gone < __lines").drop("__lines", "__gone")
