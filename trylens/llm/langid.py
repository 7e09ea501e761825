"""Operator 10: language identification by rank-order n-gram profiles.

A profile is the list of the most frequent letter n-grams (1 to 3 code points,
words padded with a boundary mark), most frequent first.  A document goes to
the language whose profile is nearest to the document's own by out-of-place
distance: the sum over its n-grams of how far apart the two ranks are, an
n-gram missing from the language counting ``top``.

Profiles are counted on at most about ``train_docs`` documents of each
language (a documented bound on the fit; chosen by a hash of the id); n-gram
counts are summed by Spark and only ``top`` n-grams per language reach the
driver.  Scoring reads every whole text in one scan without a shuffle.

Defined cases: null text or a text without letters is ``und`` with score 0;
without any training rows every text is ``und``; ties between languages go to
the smaller name, ties between n-grams to the smaller code; rows with null
lang are scored but never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

TOP = 300
TRAIN_DOCS = 4000
_FLUSH = 2_000_000       # distinct n-grams a task holds before it emits counts
_letters: np.ndarray | None = None

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def _is_letter() -> np.ndarray:
    """isalpha() of every code point, built once per worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def ngram_codes(text: str) -> np.ndarray:
    """Codes of all 1- to 3-grams of the letters of a text, 21 bits a letter."""
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    s = np.where(_is_letter()[cps], cps, 0)
    s = np.concatenate([[0], s, [0]])
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    if len(s) < 2:
        return np.zeros(0, dtype=np.int64)
    mark = 0x1FFFFF
    one = s[s != 0] | ((mark - 1) << 42)
    two = (s[:-1] << 21 | s[1:]) | (mark << 42)
    three = (s[:-2] << 42 | s[1:-1] << 21 | s[2:])[s[1:-1] != 0]
    return np.concatenate([one, two, three])


def top_codes(codes: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes, most frequent first."""
    u, n = np.unique(codes, return_counts=True)
    return u[np.lexsort((u, -n))[:top]]


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, code, n) summed over ``docs`` (lang, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out():
            for lang, (u, n) in held.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(u), pa.string()), "code": u, "n": n})

        for b in c.slices(batches, "text"):
            langs, texts = (x.to_pylist() for x in c.columns(b, ["lang", "text"]))
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(langs, texts):
                by_lang.setdefault(lang, []).append(ngram_codes(text or ""))
            for lang, parts in by_lang.items():
                u, n = np.unique(np.concatenate(parts), return_counts=True)
                if lang in held:
                    u0, n0 = held[lang]
                    u, index = np.unique(np.concatenate([u0, u]), return_inverse=True)
                    n = np.bincount(index, weights=np.concatenate([n0, n])).astype(np.int64)
                held[lang] = (u, n)
            if sum(len(u) for u, _ in held.values()) > _FLUSH:
                yield from out()
                held.clear()
        yield from out()

    parts = docs.select("lang", "text").mapInArrow(run, "lang string, code long, n long")
    return parts.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def fit_profiles(train: DataFrame, top: int = TOP, train_docs: int = TRAIN_DOCS) -> dict[str, list[int]]:
    """Language -> codes by rank, from ``train`` (doc_id, lang, text)."""
    train = train.where(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    scale = 1 << 20
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items())
                           for x in (lang, min(scale, -(-scale * train_docs // n)))])
    chosen = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < share[F.col("lang")])
    counts = count_ngrams(chosen)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= top)
    profiles: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "rank").collect():     # languages x top rows
        profiles.setdefault(r["lang"], []).append(r["code"])
    return profiles


def rank_table(profiles: dict[str, list[int]], top: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(sorted codes, ranks[code, language] with ``top`` where missing, names)."""
    names = sorted(profiles)
    codes = np.unique(np.array([x for n in names for x in profiles[n]], dtype=np.int64))
    ranks = np.full((len(codes) + 1, len(names)), top, dtype=np.int32)   # last row: in no profile
    for j, n in enumerate(names):
        ranks[np.searchsorted(codes, profiles[n]), j] = np.arange(len(profiles[n]))
    return codes, ranks, names


def nearest(text: str | None, codes: np.ndarray, ranks: np.ndarray, names: list[str], top: int) -> tuple[str, float]:
    """(language, 1 - distance / largest possible distance)."""
    own = top_codes(ngram_codes(text or ""), top)
    if not len(own) or not names:
        return "und", 0.0
    at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
    r = ranks[np.where(codes[at] == own, at, len(codes))]
    place = np.arange(len(own), dtype=np.int32)[:, None]
    distance = np.where(r < top, np.abs(r - place), top).sum(axis=0)
    best = int(distance.argmin())
    return names[best], 1.0 - float(distance[best]) / (top * len(own))


def identify(docs: DataFrame, profiles: dict[str, list[int]], top: int = TOP) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) from ``docs`` (doc_id, held_out, text)."""
    model = docs.sparkSession.sparkContext.broadcast(rank_table(profiles, top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, ranks, names = model.value
        for b in c.slices(batches, "text"):
            ids, held, texts = c.columns(b, ["doc_id", "held_out", "text"])
            got = [nearest(t, codes, ranks, names, top) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": ids, "held_out": held,
                "lang_pred": pa.array([g[0] for g in got], pa.string()),
                "score": pa.array([g[1] for g in got], pa.float64())})

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, SCHEMA)


def language_id(docs: DataFrame, top: int = TOP, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Fit on the rows whose id is not held out, then identify every row.

    ``docs`` has doc_id, text and lang; a null id counts as held out."""
    held = F.coalesce(F.pmod(c.id_crc(), F.lit(4)) == 2, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held.alias("held_out"))
    profiles = fit_profiles(rows.where(~F.col("held_out")), top, train_docs)
    return identify(rows, profiles, top)
