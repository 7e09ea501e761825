"""Operator 1: best-fit packing by a configuration linear program.

Documents become pieces of at most ``capacity`` tokens; only the histogram of
piece lengths (at most ``capacity`` numbers) reaches the driver.  There the
configuration program (fewest sequences, each filled by one multiset of
lengths) is solved by multiplicative weights: lengths still short of their
demand get a high price and a knapsack dynamic program finds the best filled
sequence at these prices.  Lengths are exact while there are at most ``CLASSES``
of them; beyond that, neighbouring lengths share a price and count as their
longest.  The fractional solution is rounded down to whole sequences; what is
left is placed best-fit decreasing into the gaps and into new sequences, and the
program's plan is used unless best-fit decreasing alone needs fewer sequences.
All of this works on groups of equal sequences, so its cost depends on the
number of different lengths, never on the number of documents.

Spark then ranks the pieces of each length (rank inside the tokenising task
plus an offset per task) and every piece looks up its place in the plan, a
table of a few thousand rows.

Defined cases: null text is empty and gives one piece with the end token;
repeated rows are packed separately; pieces of one length take their places in
the order of tasks, any order being as good; very long texts are cut into pieces
like others; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

CAPACITY = 4096
END_ID = 1
CLASSES = 512         # different prices; up to so many lengths are priced one by one
ITERATIONS = 1500     # of the multiplicative-weights loop, at most
_CACHE_RUNS = 800_000    # runs whose ids a worker remembers; full: forgotten and refilled

PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


# ---- the plan (driver, histogram only) -------------------------------------------------

def best_configuration(price: np.ndarray, size: np.ndarray, room: int) -> np.ndarray:
    """Copies of each class (ascending ``size``) in the dearest filling of ``room``."""
    best = np.zeros(room + 1)
    for s, p in zip(size.tolist(), price.tolist()):
        # 1, 2, 4, ... copies on top of each other: any number of them
        while p > 0 and s <= room:
            np.maximum(best[s:], best[:-s] + p, out=best[s:])
            s, p = 2 * s, 2 * p
    copies = np.zeros(len(size), dtype=np.int64)
    u = int(np.searchsorted(best, best[room] * (1 - 1e-12)))
    while u > 0 and best[u] > 0:
        k = int(np.searchsorted(size, u, side="right"))
        j = int((best[u - size[:k]] + price[:k]).argmax())
        copies[j] += 1
        u -= int(size[j])
    return copies


def fractional_solution(size: np.ndarray, demand: np.ndarray, room: int,
                        iterations: int) -> list[tuple[float, np.ndarray]]:
    """(weight, configuration) pairs that together about cover the demand."""
    covered = np.zeros(len(size))
    out: dict[bytes, list] = {}
    for _ in range(iterations):
        share = covered / demand
        if share.min() >= 1.0:
            break
        price = np.where(share < 1.0, np.exp(-4.0 * share), 0.0) * size ** 1.02
        config = best_configuration(price, size, room)
        used = config > 0
        if not used.any():
            break
        weight = max(0.25 * float((demand[used] / config[used]).min()),
                     float(((demand - covered)[used] / config[used]).min()))
        covered = covered + weight * config
        out.setdefault(config.tobytes(), [0.0, config])[0] += weight
    return sorted(((w, x) for w, x in out.values()), key=lambda t: (-t[0], t[1].tobytes()))


def plan_groups(hist: dict[int, int], capacity: int, most_classes: int = CLASSES,
                iterations: int = ITERATIONS) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal sequences: (how many, [(length, copies), ...]).

    The plan of the configuration program, or that of best-fit decreasing alone
    where it has fewer sequences."""
    plan = _program(dict(hist), capacity, most_classes, iterations)
    plain = [(m, slots) for m, _, slots in groups_best_fit([], {n: k for n, k in hist.items() if k > 0}, capacity)]
    return min(plan, plain, key=lambda groups: sum(m for m, _ in groups))


def _program(hist: dict[int, int], capacity: int, most_classes: int, iterations: int) -> list[tuple[int, list[tuple[int, int]]]]:
    left = {n: k for n, k in hist.items() if k > 0}
    groups: list[tuple[int, int, list[tuple[int, int]]]] = []        # (how many, gap, slots)
    if capacity in left:
        groups.append((left.pop(capacity), 0, [(capacity, 1)]))
    if left:
        room = capacity
        # neighbouring lengths share a class, which counts as its longest
        parts = np.array_split(np.array(sorted(left)), min(len(left), most_classes))
        classes = {int(x[-1]): x[::-1].tolist() for x in parts}
        size = np.array(sorted(classes), dtype=np.int64)
        demand = np.array([sum(left[n] for n in classes[k]) for k in size], dtype=float)
        most = min(iterations, 50 + 4 * int(sum(demand)))
        for weight, config in fractional_solution(size, demand, room, most) if len(size) else []:
            used = np.flatnonzero(config)
            have = [sum(left.get(n, 0) for n in classes[size[j]]) for j in used]
            times = min([int(weight + 0.5)] + [h // int(config[j]) for h, j in zip(have, used)])
            if times <= 0:
                continue
            made = [(times, capacity, [])]
            slots = [int(j) for j in reversed(used) for _ in range(int(config[j]))]
            for j in slots[:-1]:
                made = _take_slot(made, classes[size[j]], left)
            groups += _take_last(made, classes[size[slots[-1]]], left)
    return [(m, slots) for m, _, slots in groups_best_fit(groups, left, capacity)]


def _take_slot(made, lengths, left):
    """Give every sequence of ``made`` one piece of a class, longest first; a
    group splits where the exact length changes."""
    out = []
    for m, gap, slots in made:
        for n in lengths:
            t = min(m, left.get(n, 0))
            if t:
                out.append((t, gap - n, slots + [(n, 1)]))
                left[n] -= t
                m -= t
            if not m:
                break
    return out


def _take_last(made, lengths, left):
    """Close every sequence of ``made`` with the longest remaining piece that
    fits its gap, down to the class the configuration asks for."""
    out = []
    for m, gap, slots in made:
        for n in range(gap, lengths[-1] - 1, -1):
            t = min(m, left.get(n, 0))
            if t:
                out.append((t, gap - n, slots + [(n, 1)]))
                left[n] -= t
                m -= t
            if not m:
                break
        if m:
            out.append((m, gap, slots))
    return out


def groups_best_fit(groups, left, capacity):
    """Best-fit decreasing of the remaining lengths into groups of sequences."""
    at: list[list] = [[] for _ in range(capacity + 1)]
    open_gaps = np.zeros(capacity + 1, dtype=bool)

    def put(g):
        if g[0]:
            at[g[1]].append(g)
            open_gaps[g[1]] = True

    for g in groups:
        put(g)
    for n in sorted(left, reverse=True):
        k = left[n]
        while k > 0:
            gap = n + int(open_gaps[n:].argmax())
            if open_gaps[gap]:
                m, _, slots = at[gap].pop()
                open_gaps[gap] = bool(at[gap])
            else:
                m, gap, slots = k, capacity, []          # as many new sequences as could be needed
            each = gap // n
            whole = min(m, k // each)
            put((whole, gap - each * n, slots + [(n, each)]))
            k, m = k - whole * each, m - whole
            if m and 0 < k < each:
                put((1, gap - k * n, slots + [(n, k)]))
                k, m = 0, m - 1
            if slots:
                put((m, gap, slots))
    return [g for gs in at for g in gs]


def place_table(groups: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """One row per (group, length): pieces of the length with ranks from ``lo``
    go to sequences ``first + rank % many`` at ``offset + length * (rank // many)``."""
    rows, ranks, first = [], {}, 0
    for many, slots in groups:
        offset = 0
        for n, copies in slots:
            lo = ranks.get(n, 0)
            rows.append((n << 44 | lo, lo, first, many, offset, n))
            ranks[n] = lo + many * copies
            offset += n * copies
        first += many
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 6).T
    return dict(zip(("key", "lo", "first", "many", "offset", "length"), cols))


# ---- the pieces (executors) ------------------------------------------------------------

def _latin(kind: str) -> str:
    """Regex class of the code points below U+0250 of one general category."""
    return "".join(f"\\u{i:04x}" for i in range(0x250) if unicodedata.category(chr(i))[0] == kind)


class RunIds:
    """Token ids of texts as little-endian 32-bit bytes, run by run.

    The tokenizer drops white space and splits into runs of letters, single
    digits and runs of other characters before its merges, so a text's ids are
    those of its runs one after the other.  Runs are remembered up to a bound.
    Texts with letters beyond the Latin blocks or a special token's mark go to
    the tokenizer whole.
    """

    # the tokenizer's own split pattern (a fixed value of the vocabulary file),
    # written for the Latin blocks
    _SPACE = r"\x09-\x0d\x20\x85\xa0"
    _RUNS = re.compile("'(?:s|t|re|ve|m|ll|d)|[%s]+|[%s]|[^%s]+" % (
        _latin("L"), _latin("N"), _SPACE + _latin("L") + _latin("N")))
    _OTHER = re.compile("[^\x00-\u024f]|<[|]")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)    # ids that end a run
        for token, i in vocab.items():
            self.closes[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}

    def _learn(self, runs: list[str], together: int = 64) -> None:
        parts = [runs[i:i + together] for i in range(0, len(runs), together)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts],
                                                                   add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            raw, start = ids.tobytes(), 0
            for run, end in zip(part, ((np.flatnonzero(self.closes[ids]) + 1) * 4).tolist()):
                self.known[run] = raw[start:end]
                start = end

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > _CACHE_RUNS:
            self.known.clear()
        out: list[bytes | None] = [None] * len(texts)
        later, new = [], set()
        for i, t in enumerate(texts):
            s = t.decode("utf-8")
            low = s.lower()
            if self._OTHER.search(low):         # of some letters only the small form lies beyond the blocks
                out[i] = np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, dtype="<u4").tobytes()
                continue
            runs = self._RUNS.findall(low)
            ids = list(map(self.known.get, runs))
            if None in ids:
                later.append((i, runs))
                new.update(r for r, x in zip(runs, ids) if x is None)
            else:
                out[i] = b"".join(ids)
        self._learn(list(new))
        for i, runs in later:
            out[i] = b"".join(map(self.known.__getitem__, runs))
        return out


@functools.lru_cache(maxsize=1)
def run_ids(path: str) -> RunIds:
    """One per worker process: what it remembers serves all its tasks."""
    return RunIds(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
           keep_ids: bool = False) -> DataFrame:
    """Tokenise and cut: ``PIECES`` (and ``ids`` when asked for).  ``part`` and
    ``nth`` number the pieces of one length inside the task that made them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = run_ids(tokenizer_path)
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in c.slices(batches, "text"):
            doc_ids = c.columns(b, ["doc_id"])[0].to_pylist()
            out: list[list] = [[] for _ in range(7)]
            kept = []
            for doc_id, ids in zip(doc_ids, ids_of(c.text_bytes(b))):
                ids += end
                for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                    x = ids[4 * start:4 * (start + capacity)]
                    n = len(x) // 4
                    for col, v in zip(out, (doc_id, k, start, n, zlib.crc32(x), part, seen[n])):
                        col.append(v)
                    seen[n] += 1
                    if keep_ids:
                        kept.append(np.frombuffer(x, dtype="<i4"))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            arrays = [pa.array(v, t) for v, t in zip(out, kinds)]
            names = [f.split()[0] for f in PIECES.split(", ")]
            if keep_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text") \
               .mapInArrow(run, PIECES + (", ids array<int>" if keep_ids else ""))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
         keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset (and ids when asked for)."""
    rows = c.materialize(pieces(docs, tokenizer_path, capacity, end_id, keep_ids), "pack-pieces")
    per_task = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    hist = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    place = docs.sparkSession.sparkContext.broadcast(place_table(plan_groups(hist, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rows.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = place.value
        for b in batches:
            if not b.num_rows:
                continue
            n, rank = (x.to_numpy(zero_copy_only=False) for x in c.columns(b, ["length", "rank"]))
            at = np.searchsorted(p["key"], n << 44 | rank, side="right") - 1
            d = rank - p["lo"][at]
            yield pa.RecordBatch.from_arrays(
                c.columns(b, keep) + [pa.array(p["first"][at] + d % p["many"][at]),
                                      pa.array(p["offset"][at] + n * (d // p["many"][at]))],
                names=keep + ["sequence_id", "offset"])

    keep = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if keep_ids else [])
    schema = ("doc_id long, piece int, start long, length long, ids_crc32 long"
              + (", ids array<int>" if keep_ids else "") + ", sequence_id long, offset long")
    return ranked.select(*keep, "rank").mapInArrow(run, schema)
