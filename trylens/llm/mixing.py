"""Operator 9: mix sources to target weights with hash-threshold histograms.

Everything is DataFrame expressions.  Every document gets a 60-bit hash of its
id; a source takes the documents below a threshold.  The threshold is found
from a histogram of words per (source, 12-bit hash prefix): whole buckets are
taken while they fit the budget, and only the rows of the one boundary bucket
per source are looked at again with the next 12 bits, and of that bucket with
the rest.  No rows are sorted.

The document at a threshold does not fit what is left of the budget.  It is left
out and the search goes on behind it, among the documents no larger than what is
left, for a budget of that size; after ``PASSES`` thresholds the last such
document is taken if that ends nearer to the target.

Defined cases: null text has size 0; a null source is a source of its own,
last in code-point order; rows with the same doc_id share one hash, so equal rows
are taken or left together; documents of size 0 count no words, wherever they
fall; very long texts are documents like others; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize

# Hash bits below a bucket of each histogram: buckets of 12 bits, of 24 bits, and
# of all 60 for the few documents of one 24-bit bucket.
SHIFTS = (48, 36, 0)
PASSES = 3     # thresholds of a source, each for what the one before it left over


def _same_source(a: DataFrame, b: DataFrame, extra=None):
    cond = a["source"].eqNullSafe(b["source"])
    return cond if extra is None else cond & extra


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source", keep: Column | None = None) -> DataFrame:
    """(doc_id, source, size in words, u = 60-bit hash of the id), and ``keep``."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("u"), *([] if keep is None else [keep]))


def targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """Per source: its size, weight and target (one row per source).

    Targets share the total of all sizes by weight, stop at ``max_repeat``
    times the source's size, and the excess is shared again by weight: with
    sources in order of size/weight, the level is the first that no remaining
    source exceeds.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", w).withColumn("top", (F.col("source_size") * max_repeat).cast("double"))
    by_fill = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    done, rest = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(everything).cast("double")
                                   - F.coalesce(F.sum("top").over(done), F.lit(0.0))) / F.sum("weight").over(rest))
    per = per.withColumn("place", F.row_number().over(by_fill))
    per = per.withColumn("first", F.min(F.when(F.col("level") * F.col("weight") <= F.col("top"), F.col("place")))
                         .over(everything))
    per = per.withColumn("level", F.max(F.when(F.col("place") == F.col("first"), F.col("level"))).over(everything))
    return per.select("source", "source_size",
                      F.least(F.col("top"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"))


def _boundary(rows: DataFrame, goals: DataFrame, level: int) -> DataFrame:
    """Per source, the bucket of this level whose words cross the budget:
    (source, cut = its first hash, left = budget that remains inside it, words)."""
    shift = SHIFTS[level]
    hist = (rows.withColumn("bucket", F.shiftright(F.col("u"), shift))
                .groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("upto", F.sum("words").over(upto))
    g = goals.select(F.col("source").alias("g_source"), "left")
    over = hist.join(g, F.col("source").eqNullSafe(F.col("g_source"))).where(F.col("upto") > F.col("left"))
    return (over.groupBy("source")
                .agg(F.min(F.struct("bucket", (F.col("left") - (F.col("upto") - F.col("words"))).alias("left"), "words")).alias("m"))
                .select("source", F.shiftleft(F.col("m.bucket"), shift).alias("cut"), F.col("m.left").alias("left"), "m.words"))


def _threshold(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source whose ``rows`` exceed its budget ``left``: the hash at which they
    do, the budget that remains before it, and the words at it."""
    inside, need = rows, goals
    for level, shift in enumerate(SHIFTS):
        need = materialize(_boundary(inside, need, level), "mix-cut")
        if not shift:
            return need
        edge = need.select(F.col("source").alias("c_source"), "cut")
        inside = materialize(
            inside.join(edge, F.col("source").eqNullSafe(F.col("c_source"))
                        & (F.shiftright(F.col("u"), shift) == F.shiftright(F.col("cut"), shift)))
                  .select("source", "size", "u"), "mix-edge")


def thresholds(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """One row per source: source_size, target, whole (copies that all its
    documents get) and, per pass, ``cut`` and ``left``; ``nearer`` is whether the
    last crossing document is taken."""
    goals = targets(rows, weights, max_repeat)
    whole = F.when(F.col("source_size") > 0,
                   F.least(F.lit(float(max_repeat)), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    goals = goals.withColumn("whole", whole.cast("long"))
    # whole words: sums of sizes are compared with it
    goals = materialize(goals.withColumn("left", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")), "mix-goals")
    plan, need, todo = goals.drop("left"), goals, rows
    for k in range(PASSES):
        cut = _threshold(todo, need)
        own = cut.select(F.col("source").alias("c_source"), F.col("cut").alias(f"cut{k}"), F.col("left").alias(f"left{k}"),
                         F.col("words").alias(f"words{k}"))
        plan = plan.join(own, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source")
        if k < PASSES - 1:
            todo = materialize(todo.join(own, F.col("source").eqNullSafe(F.col("c_source"))
                                         & (F.col("u") > F.col(f"cut{k}")) & (F.col("size") <= F.col(f"left{k}")))
                                   .select("source", "size", "u"), "mix-rest")
            need = cut
    last = PASSES - 1
    return plan.withColumn("nearer", F.coalesce(F.col(f"words{last}") < 2 * F.col(f"left{last}"), F.lit(False)))


def with_copies(rows: DataFrame, plan: DataFrame, max_repeat: int = 3) -> DataFrame:
    """``rows`` (source, size, u, more) with source_size, target and copies."""
    x = rows.join(plan.withColumnRenamed("source", "p_source"), F.col("source").eqNullSafe(F.col("p_source")))
    taken = F.lit(False)
    for k in range(PASSES):
        # without a cut everything that takes part in this pass fits
        part = F.lit(True) if not k else F.coalesce((F.col("u") > F.col(f"cut{k - 1}")) & (F.col("size") <= F.col(f"left{k - 1}")), F.lit(False))
        below = F.col(f"cut{k}").isNull() | (F.col("u") < F.col(f"cut{k}"))
        if k == PASSES - 1:
            below = below | (F.col("nearer") & (F.col("u") == F.col(f"cut{k}")))
        taken = taken | (part & below)
    return x.withColumn("copies", F.least(F.lit(max_repeat).cast("long"), F.col("whole") + taken.cast("long")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies): ``copies`` is how
    often the mix takes the document, ``taken`` its words with repeats."""
    rows = materialize(sized(docs, id_col, text_col, source_col), "mix-rows")
    x = with_copies(rows, thresholds(rows, weights, max_repeat), max_repeat)
    return x.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """The mixed documents themselves: each row as often as the mix takes it, with
    exactly the input's columns.  A row's copies follow from its own source, size
    and hash, so rows of one doc_id in two sources keep their own numbers."""
    rows = materialize(sized(docs), "mix-rows")
    own = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    x = with_copies(sized(docs, keep=own), thresholds(rows, weights, max_repeat), max_repeat)
    x = x.select("row", F.explode(F.expr("if(copies > 0, sequence(1L, copies), array())")).alias("i"))
    return x.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


ORACLE = r"""
WITH n AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS u
  FROM documents),
p AS (SELECT source, sum(size) AS source_size FROM n GROUP BY source),
w AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, CAST(source_size * 3 AS DOUBLE) AS top,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM p),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(top) OVER (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY top / weight, source NULLS LAST) AS place FROM w),
f AS (SELECT *, min(CASE WHEN level * weight <= top THEN place END) OVER () AS first FROM l),
g AS (
  SELECT source, source_size,
         least(top, coalesce(max(CASE WHEN place = first THEN level END) OVER (), 0.0) * weight) AS target FROM f),
h AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS whole FROM g),
c0 AS (
  SELECT n.doc_id, n.source, n.size, n.u, h.source_size, h.target, h.whole, CAST(floor(h.target - h.whole * h.source_size) AS BIGINT) AS rest
  FROM n JOIN h ON n.source IS NOT DISTINCT FROM h.source),
@PASSES@
SELECT doc_id, size, source_size, target, CAST(size * least(3, whole + take) AS BIGINT) AS taken, CAST(least(3, whole + take) AS BIGINT) AS copies
FROM (SELECT *, CASE WHEN @TAKEN@ THEN 1 ELSE 0 END AS take FROM c@LAST@)
"""

# A pass: the running words of what is left, the hash at which they pass the
# budget, the budget before it and the words at it, one set of columns a pass.
_PASS = """c{n} AS (
  SELECT *, min(CASE WHEN upto{k} > b{k} THEN u END) OVER s AS cut{k},
         b{k} - coalesce(max(CASE WHEN upto{k} <= b{k} THEN upto{k} END) OVER s, 0) AS left{k} FROM (
    SELECT *, {budget} AS b{k}, CASE WHEN {part} THEN sum(CASE WHEN {part} THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY u) END AS upto{k}
    FROM c{k})
  WINDOW s AS (PARTITION BY source))"""
_PARTS = ["true"] + [f"coalesce(u > cut{k - 1} AND size <= left{k - 1}, false)" for k in range(1, PASSES)]
_END = PASSES - 1
_NEARER = (f"(u = cut{_END} AND min(CASE WHEN upto{_END} > b{_END} THEN upto{_END} END) OVER (PARTITION BY source)"
           f" - (b{_END} - left{_END}) < 2 * left{_END})")
ORACLE = (ORACLE
          .replace("@PASSES@", ",\n".join(_PASS.format(n=k + 1, k=k, part=_PARTS[k], budget="rest" if not k else f"left{k - 1}")
                                          for k in range(PASSES)))
          .replace("@TAKEN@", " OR ".join(f"({_PARTS[k]} AND (cut{k} IS NULL OR u < cut{k}" + (f" OR {_NEARER}" if k == _END else "") + "))"
                                          for k in range(PASSES)))
          .replace("@LAST@", str(PASSES)))
