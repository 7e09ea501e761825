"""Operator 12: spelling variants found by a relational trie frontier.

Words are counted over all texts.  Two words are near when they differ by one
inserted, deleted or replaced code point.  Near words are found by walking all
words at once through tries held as one distributed edge table: a state (word,
position, node, edits) joins the edges of its node, advances past an edge whose
characters equal the word's, and past one that differs by one edit while no
edit is used.  A state that reaches the end of a word with one edit names a
near word.

What keeps the frontier narrow:

* One edit lies in the first or in the second half of a word, so every word
  walks a trie of the words and one of the reversed words, and enters each at
  the node of its own unchanged half.  Edits are spent only behind it.
* There is a trie per word length and kind of edit (replace: the word's own
  length, delete: one less); an insertion is a deletion seen from the other
  word, and a replacement is looked for in one direction only.
* Edges hold 2, 4, 8, ... characters from the entry node on, so the levels grow
  with the logarithm of the longest word.

Nodes are 64-bit hashes of trie and prefix; an exact distance check follows.

``variants`` then gives every word its most frequent near word when that is
``RATIO`` times as frequent (its form) and follows forms to the last one (its
root) by joins of the table with itself, doubling the steps each round.

Defined cases: a null text has no words; a null doc_id counts as the empty
text in the noise rule; repeated rows count again; ties go to the smaller word in
code-point order; an empty table gives an empty result; words and texts have no
greatest length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
NOISE = 31                # one of so many runs loses a code point
# [A-Za-zÀ-ÿ] after A-Z became a-z; greedy from a run's first letter on, so
# shorter runs never match and longer ones match whole
_RUN = re.compile("[a-z\u00c0-\u00ff]{%d,}" % MIN_LENGTH)
_LONG = 1 << 22           # from so many characters on, runs are not listed at once
_FLUSH = 1 << 17          # distinct words a task holds before it hands them on
FIRST = 2                 # characters of a trie's first edges


def noisy_word(doc_id: bytes, word: str) -> str:
    """The run, without the code point the noise rule deletes if it does."""
    h = zlib.crc32(word.encode("utf-8"), zlib.crc32(doc_id + b":"))
    at = h % len(word)
    return word if h % NOISE else word[:at] + word[at + 1:]


def runs(text: bytes) -> Iterable[str]:
    """The lower-cased runs of a text that are long enough."""
    t = text.lower().decode("utf-8")                 # bytes: lower() changes A-Z only
    return _RUN.findall(t) if len(t) < _LONG else map(itemgetter(0), _RUN.finditer(t))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): words of enough code points and occurrences."""
    def emit(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                          names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in c.slices(batches):
            for i, text in zip(c.columns(b, ["doc_id"])[0].to_pylist(), c.text_bytes(b)):
                doc = b"" if i is None else str(i).encode()
                for found, n in Counter(runs(text)).items():
                    word = noisy_word(doc, found)
                    if len(word) >= MIN_LENGTH:
                        counts[word] += n
            if len(counts) >= _FLUSH:
                yield emit(counts)
                counts.clear()
        yield emit(counts)

    rows = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _tries(words: DataFrame) -> DataFrame:
    """(word, path, m, delete, back): each word as it walks, four times.

    ``back``: read from the end; ``delete``: looks for words one code point
    shorter, else for words of its length."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("delete"), F.lit(b).alias("back")) for d in (0, 1) for b in (0, 1)]))
    x = words.select("word", each.alias("t")).select("word", "t.*")
    return x.withColumn("path", F.when(F.col("back") == 1, F.reverse("word")).otherwise(F.col("word"))) \
            .withColumn("m", F.length("word"))


def _entry(length: Column) -> Column:
    """Where a walker of ``length`` enters: behind its unchanged half."""
    half = F.floor(length / 2).cast("int")
    return F.when(F.col("back") == 1, length - half).otherwise(half)


def _node(length: Column, depth: Column) -> Column:
    """The node of a prefix of ``path`` in the trie of words of ``length``."""
    return F.xxhash64("delete", "back", length, F.substring("path", F.lit(1), depth))


def levels(longest: int) -> int:
    """Levels of the tries of words up to ``longest``: edges of FIRST, 2 * FIRST, ...
    characters behind the entry, which stands at the middle of a word."""
    n = 0
    while FIRST * ((1 << n) - 1) < (longest + 1) // 2:
        n += 1
    return n


def edges(words: DataFrame, longest: int) -> DataFrame:
    """(level, node, label, child, near): the edges of all tries; ``near`` is the
    word that ends with the edge."""
    # in a delete trie the walkers are one longer than the word
    x = _tries(words).withColumn("entry", _entry(F.col("m") + F.col("delete")))
    bounds = F.array(*[F.struct(F.lit(j).alias("level"), F.lit(FIRST * ((1 << j) - 1)).alias("lo"),
                                F.lit(FIRST * ((2 << j) - 1)).alias("hi")) for j in range(levels(longest))])
    x = x.select("*", F.explode(bounds).alias("b")).where(F.col("entry") + F.col("b.lo") < F.col("m"))
    x = x.withColumn("at", F.col("entry") + F.col("b.lo")).withColumn("to", F.least(F.col("entry") + F.col("b.hi"), "m"))
    return x.select(F.col("b.level").alias("level"), _node(F.col("m"), F.col("at")).alias("node"),
                    F.substring("path", F.col("at") + 1, F.col("to") - F.col("at")).alias("label"),
                    _node(F.col("m"), F.col("to")).alias("child"),
                    F.when(F.col("to") == F.col("m"), F.col("word")).alias("near")).distinct()


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): both directions of every pair of near words."""
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    trie = c.materialize(edges(words, longest), "spelling-edges") if longest else None
    x = _tries(words).withColumn("position", _entry(F.col("m")))
    frontier = x.select("word", "path", "m", "delete", "position",
                        _node(F.col("m") - F.col("delete"), F.col("position")).alias("node"), F.lit(0).alias("edits"))
    found = None
    for level in range(levels(longest)):
        step = trie.where(F.col("level") == level).drop("level")
        # characters of the edges a walker may take here, from its depth in the trie
        depth = F.col("position") - F.col("edits") * F.col("delete")
        x = frontier.withColumn("size", F.least(F.lit(FIRST << level), F.col("m") - F.col("delete") - depth))
        piece = F.substring("path", F.col("position") + 1, F.col("size"))
        longer = F.substring("path", F.col("position") + 1, F.col("size") + 1)
        # edges that equal the word's own characters; a word's way to itself is left out
        own = x.where("not (delete = 0 and edits = 0 and position + size = m)").withColumn("label", piece)
        same = own.join(step, ["node", "label"]).withColumn("further", F.col("size"))
        # edges one edit away, for walkers that have none yet.  An edit leaves the
        # first or the last character (a lone one is replaced)
        ends = lambda a, b: (F.left(a, F.lit(1)) == F.left(b, F.lit(1))) | (F.right(a, F.lit(1)) == F.right(b, F.lit(1)))
        replaced = (F.col("delete") == 0) & (F.col("label") > F.col("piece")) & (ends(F.col("label"), F.col("piece")) | (F.col("size") == 1)) \
            & (F.levenshtein("label", "piece", 1) == 1)
        deleted = (F.col("delete") == 1) & ends(F.col("label"), F.col("longer")) & (F.levenshtein("label", "longer", 1) == 1)
        free = x.where("edits = 0").withColumn("piece", piece).withColumn("longer", longer)
        other = free.join(step, "node").where(replaced | deleted) \
                    .withColumn("further", F.col("size") + F.col("delete")).withColumn("edits", F.lit(1))
        kept = ["word", "path", "m", "delete", (F.col("position") + F.col("further")).alias("position"), F.col("child").alias("node"),
                "edits", "near"]
        x = c.materialize(same.select(*kept).unionByName(other.select(*kept)), "spelling-frontier")
        # the end of a word: one edit spent, or the walker's last character left over
        reached = x.where("near is not null").select("word", "near")
        found = reached if found is None else found.unionByName(reached)
        frontier = x.where("near is null").drop("near")
    if found is None:
        return words.select("word", F.col("word").alias("near")).limit(0)
    pairs = found.where(F.levenshtein("word", "near", 1) == 1)
    return pairs.select(F.explode(F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"))))
                        .alias("p")).select("p.*").distinct()


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) for each row of ``forms`` (word, form): the last form.

    Counts grow along forms, so there are no circles; the steps double."""
    at = c.materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("via"), F.col("root").alias("next"))
        x = at.join(on, F.col("root") == F.col("via"), "left")
        x = c.materialize(x.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                          "spelling-roots")
        at = x.drop("moved")
        if not x.where("moved").limit(1).count():
            return at


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n)."""
    near = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("b"))
    x = words.join(best, "word", "left")
    ok = -F.col("b.minus") >= RATIO * F.col("n")
    x = x.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                 F.when(ok, F.col("b.near")).alias("form"), F.when(ok, -F.col("b.minus")).alias("form_n"))
    x = c.materialize(x, "spelling-forms")
    roots = follow(x.where("form is not null"))
    return x.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Words of ``docs`` with their near words, forms and roots."""
    return variants(c.materialize(word_counts(docs), "spelling-words"))


# crc32 byte by byte over all words at once: the table by eight halvings, the
# words' bytes by a recursive join.
ORACLE = f"""
WITH RECURSIVE
bits(i, k, v) AS (
  SELECT i::UBIGINT, 0, i::UBIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT i, v FROM bits WHERE k = 8),
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL),
crc(doc_id, run, n, h, pos, v) AS (
  SELECT doc_id, run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), 0, 4294967295::UBIGINT FROM runs
  UNION ALL
  SELECT c.doc_id, c.run, c.n, c.h, c.pos + 1, xor(c.v >> 8, t.v)
  FROM crc c JOIN tab t ON t.i = xor(c.v & 255, ('0x' || substr(c.h, 2 * c.pos + 1, 2))::UBIGINT)
  WHERE 2 * c.pos < length(c.h)),
noisy AS (
  SELECT run, n, xor(v, 4294967295::UBIGINT) AS v FROM crc WHERE 2 * pos = length(h)),
w AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN v % {NOISE} = 0 THEN substr(run, 1, (v % length(run))::INT) || substr(run, (v % length(run))::INT + 2)
                ELSE run END AS word, n FROM noisy)
  WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
cut AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (
  SELECT DISTINCT word, near, near_n FROM (
    SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION ALL SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word
    UNION ALL SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word)),
best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
f AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN near_n >= {RATIO} * w.n THEN near END AS form, CASE WHEN near_n >= {RATIO} * w.n THEN near_n END AS form_n
  FROM w LEFT JOIN best ON w.word = best.word),
walk(word, pos) AS (
  SELECT word, word FROM f
  UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.pos = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.pos AS root, f.n, f.n_near, f.form_n
FROM f JOIN walk ON f.word = walk.word JOIN f z ON walk.pos = z.word AND z.form IS NULL
"""
