"""Operator 5: quality rules from suffix-array repetition.

Per document: a suffix array over its words with longest common prefixes of
neighbours; the intervals of equal prefixes are its maximal repeated
substrings.  The union of the spans of all maximal repeats of at least
``min_repeat`` words gives the covered fraction; the longest common prefix is
the longest repeat.  A document is kept when the base rules hold and neither
figure passes its limit.

The suffix arrays of all documents of a chunk are built together (ranks start
as (document, word), so suffixes of different documents never tie) by prefix
doubling on the positions that still tie.  Tables are scanned once, nothing is
shuffled.

Defined cases: null or empty text has no words and fails the base rules;
repeated rows each get their own equal row; a text without repeats has covered
fraction 0; very long texts are a chunk of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c

MIN_WORDS = 50            # base rule: shorter texts fail
MIN_REPEAT = 8            # words: shorter repeats are ordinary language
# A covered word is also a repeated word of the base rule, so both limits lie
# well below its half: scattered copied sentences by the usual share of repeated
# 8-word windows, one copied passage (twice its length is covered) by its own.
MAX_COVERED = 0.12        # of the words may lie in repeats
MAX_LONGEST = 0.03        # longest repeat as a share of the words ...
LONGEST_FLOOR = 100       # ... once it has this many words
_SYMBOLS = [s.encode() for s in "#*$%&|<>"]
_SPACES = [bytes([b]) for b in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)]

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "longest_repeat long, n_covered_words long, base_failed boolean, kept boolean")


def suffix_ranks(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array and the rank arrays of each doubling step.

    ``first``: equal values for equal words of one document, different values
    in different documents.  ``end``: one past the last position of each
    position's document.  Step k ranks suffixes by their first 2**k words.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    new = np.concatenate([[True], first[order][1:] != first[order][:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    steps = [rank]
    width = 1
    same = ~new
    tied = order[same | np.concatenate([same[1:], [False]])]
    while len(tied):
        rank = steps[-1]
        after = tied + width
        inside = after < end[tied]
        second = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[tied]))
        tied, second = tied[by], second[by]
        old = rank[tied]
        group = np.concatenate([[True], old[1:] != old[:-1]])
        new = group | np.concatenate([[True], second[1:] != second[:-1]])
        at = np.arange(len(tied))
        in_group = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        rank = rank.copy()
        rank[tied] = old + in_group
        steps.append(rank)
        width *= 2
        same = ~new
        tied = tied[same | np.concatenate([same[1:], [False]])]
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[steps[-1]] = np.arange(n)
    return suffixes, steps


def neighbour_prefixes(suffixes: np.ndarray, steps: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it in order
    (0 for the first), from the rank arrays, longest step first."""
    n = len(suffixes)
    lcp = np.zeros(n, dtype=np.int64)
    live = np.flatnonzero(steps[0][suffixes[1:]] == steps[0][suffixes[:-1]]) + 1
    p, q = suffixes[live - 1], suffixes[live]
    got = np.zeros(len(live), dtype=np.int64)
    for k in range(len(steps) - 1, -1, -1):
        a, b = p + got, q + got
        ok = (a + (1 << k) <= end[p]) & (b + (1 << k) <= end[q])
        same = ok & (steps[k][np.minimum(a, n - 1)] == steps[k][np.minimum(b, n - 1)])
        got += same.astype(np.int64) << k
    lcp[live] = got
    return lcp


def repeat_cover(first: np.ndarray, end: np.ndarray, min_repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """(covered?, longest repeat starting here) per position.

    A position's longest repeat is the larger prefix with its two neighbours
    in suffix order: the deepest prefix interval it belongs to.  The union of
    the maximal repeats of at least ``min_repeat`` words is the union of these
    spans, as every such repeat is the deepest one of its leftmost position or
    is contained in one.
    """
    n = len(first)
    if n == 0:
        return np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)
    suffixes, steps = suffix_ranks(first, end)
    lcp = neighbour_prefixes(suffixes, steps, end)
    longest = np.empty(n, dtype=np.int64)
    longest[suffixes] = np.maximum(lcp, np.concatenate([lcp[1:], [0]]))
    reach = np.where(longest >= min_repeat, np.arange(n) + longest, 0)
    covered = np.maximum.accumulate(reach) > np.arange(n)
    return covered, longest


def _per_doc_sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def measure(texts: list[bytes], min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """All counts of a chunk of texts, one array entry per text."""
    words_of = [t.split() for t in texts]
    counts = np.array([len(w) for w in words_of], dtype=np.int64)
    at = c.offsets_of(counts)
    h = c.word_hashes([w for ws in words_of for w in ws])
    doc = np.repeat(np.arange(len(texts)), counts)
    end = np.repeat(at[1:], counts)
    own = c.mix64(h ^ c.mix64(doc.astype(np.uint64) + np.uint64(1)))
    # 3-word windows found twice or more inside one text
    repeated = np.zeros(len(h), dtype=bool)
    windows = c.window_hashes(own, 3)
    if len(windows):
        inside = np.arange(len(windows)) + 3 <= end[:len(windows)]
        w = windows[inside]
        _, index, times = np.unique(w, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(inside)[times[index] > 1]
        for j in range(3):
            repeated[starts + j] = True
    covered, longest = repeat_cover(own, end, min_repeat)
    longest_of = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(longest_of, doc, longest)
    dup_lines = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip()]
        dup_lines[i] = len(lines) - len(set(lines))
    chars = np.fromiter((len(t.decode("utf-8")) for t in texts), np.int64, len(texts))
    spaces = np.fromiter((sum(t.count(s) for s in _SPACES) for t in texts), np.int64, len(texts))
    symbols = np.fromiter((sum(t.count(s) for s in _SYMBOLS) for t in texts), np.int64, len(texts))
    return {"n_words": counts, "word_chars": chars - spaces, "n_symbols": symbols, "n_dup_lines": dup_lines,
            "n_repeat_words": _per_doc_sum(repeated, at), "longest_repeat": longest_of,
            "n_covered_words": _per_doc_sum(covered, at)}


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) from the counts of ``measure``."""
    n = m["n_words"]
    base_failed = (n < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * n)
    bad = ((m["n_covered_words"] > MAX_COVERED * n)
           | ((m["longest_repeat"] > MAX_LONGEST * n) & (m["longest_repeat"] >= LONGEST_FLOOR)))
    return base_failed, ~base_failed & ~bad


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the columns of ``SCHEMA``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.slices(batches, "text"):
            m = measure(c.text_bytes(b))
            failed, kept = verdict(m)
            (ids,) = c.columns(b, ["doc_id"])
            yield pa.RecordBatch.from_pydict({"doc_id": ids, **m, "base_failed": failed, "kept": kept})
    return docs.selectExpr(f"cast(`{id_col}` as long) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents the rules keep, with exactly the input's columns; rows
    stay where they are (no join, no shuffle)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.slices(batches, text_col):
            _, kept = verdict(measure(c.text_bytes(b, text_col)))
            yield b.filter(pa.array(kept))
    return docs.mapInArrow(run, docs.schema)
