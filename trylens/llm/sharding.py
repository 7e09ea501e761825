"""Operator 8: shards of equal counts by balanced label propagation.

Documents are linked when they share a group (equal texts in the registered
query).  Every document starts with a hashed label; in each round a group
looks at its members' labels through a join, asks for the shard most of them
carry among those with room for all of it, and moves there as a whole when the
shard's quota still allows it (largest groups first, found from a histogram of
requests).  Groups beyond a shard's quota are cut into quota-sized parts first:
they must span shards.  What is left (unlinked documents, and groups no shard
has room for) fills the remaining room in group order, so a group is cut by
shard bounds at most.

Law ``rows``: the shards' counts differ by at most one.  Only numbers per shard
reach the driver.

Defined cases: null text is a text of its own (size 16, crc of the empty text);
rows with equal id and text rank side by side in any order; with fewer
documents than shards some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

SHARDS = 40
ROUNDS = 4


def positive_hash(*cols) -> Column:
    """A 62-bit non-negative hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 2)


def document_nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, grp, u): one narrow row per document; ``grp``
    is equal for equal texts, ``u`` a hash that orders documents."""
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                    (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
                    F.crc32(raw).alias("text_crc32"),
                    F.xxhash64(F.col("text").isNull(), F.col("text"), F.crc32(raw)).alias("grp"))
    return x.withColumn("u", positive_hash("doc_id", "grp"))


def _below(bounds: list[int], value: Column) -> Column:
    """How many of a few literal bounds are at or below ``value``."""
    n = F.lit(0)
    for b in bounds:
        n = n + (value >= F.lit(b)).cast("int")
    return n


def _grant(asks: DataFrame, room: dict[int, int]) -> DataFrame:
    """The requests (part, n, shard) that fit their shard's room, large groups
    first: whole levels of the request histogram up to the first that passes it."""
    spark = asks.sparkSession
    level = ((F.lit(63) - F.floor(F.log2("n"))) * 1024 + F.shiftright(F.col("part_hash"), 52)).cast("int")
    asks = asks.withColumn("level", level)
    upto = Window.partitionBy("shard").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    rooms = F.broadcast(spark.createDataFrame(sorted(room.items()), "shard int, room long"))   # one row a shard
    cut = (asks.groupBy("shard", "level").agg(F.sum("n").alias("n"))
               .withColumn("upto", F.sum("n").over(upto)).join(rooms, "shard")
               .where(F.col("upto") > F.col("room")).groupBy("shard").agg(F.min("level").alias("cut")))
    return (asks.join(F.broadcast(cut), "shard", "left")       # one row a shard
                .where(F.col("cut").isNull() | (F.col("level") < F.col("cut"))))


def propagate(nodes: DataFrame, shards: int, quota: int, rounds: int = ROUNDS) -> DataFrame:
    """(part, shard) of the linked parts that found a shard; a part is a group
    or a quota-sized piece of one.  ``nodes`` has part, part_hash and u."""
    spark = nodes.sparkSession
    room = {s: quota for s in range(shards)}
    labels = nodes.select("part", "part_hash", F.pmod(F.xxhash64("u"), F.lit(shards)).cast("int").alias("label"))
    votes = c.materialize(labels.groupBy("part", "part_hash", "label").agg(F.count("*").alias("votes")), "shard-votes")
    sizes = c.materialize(votes.groupBy("part", "part_hash").agg(F.sum("votes").alias("n")).where("n > 1"), "shard-parts")
    placed = []
    waiting = sizes
    for k in range(rounds):
        free = F.broadcast(spark.createDataFrame(sorted(room.items()), "shard int, room long"))   # one row a shard
        near = (waiting.join(votes.select("part", F.col("label").alias("shard"), "votes"), "part")
                       .join(free, "shard").where(F.col("room") >= F.col("n"))
                       .groupBy("part", "part_hash", "n")
                       .agg(F.max_by("shard", F.struct("votes", F.xxhash64("part", "shard"))).alias("shard")))
        granted = c.materialize(_grant(near, room).select("part", "shard", "n"), "shard-moves")
        took = granted.groupBy("shard").agg(F.sum("n").alias("n")).collect()       # one row a shard
        placed.append(granted.select("part", "shard"))
        if not took:
            break
        for r in took:
            room[r["shard"]] -= r["n"]
        if k < rounds - 1:
            # neighbours that moved carry their new label; those left ask again
            waiting = c.materialize(waiting.join(granted.select("part"), "part", "left_anti"), "shard-waiting")
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def assign(nodes: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``nodes`` (any columns, with grp and u) plus shard and slot."""
    total = nodes.count()
    quota = total // shards
    per = nodes.groupBy("grp").agg(F.count("*").alias("g_n")).where("g_n > 1")
    pieces = F.ceil(F.col("g_n") / F.lit(max(1, quota)))
    x = nodes.join(per, "grp", "left")
    piece = F.when(F.col("g_n") > quota, F.floor(F.col("u") / F.lit(float(1 << 62)) * (pieces + 1))).otherwise(0)
    x = x.withColumn("part", F.xxhash64("grp", piece.cast("long"))).withColumn("part_hash", positive_hash("part"))
    x = c.materialize(x, "shard-nodes")
    moved = propagate(x.where("g_n is not null"), shards, quota, rounds)
    x = c.materialize(x.join(moved, "part", "left").drop("g_n"), "shard-moved")
    load = {r["shard"]: r["n"] for r in x.where("shard is not null").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    # the rest, ranked in group order, fills the room that is left in each shard
    bounds, filled, take = [], 0, []
    for s in range(shards):
        n = quota + (s < total % shards) - load.get(s, 0)
        if n > 0:
            filled += n
            bounds.append(filled)
            take.append(s)
    rest = c.rank_within(x.where("shard is null").drop("shard").withColumn("one", F.lit(1)),
                         "one", "part_hash", "rank", buckets=1 << 14)
    rest = rest.withColumn("shard", F.element_at(F.array(*[F.lit(s) for s in take or [0]]),
                                                 _below(bounds[:-1], F.col("rank")) + 1))
    cols = [n for n in x.columns if n not in ("part", "part_hash", "shard")]
    done = x.where("shard is not null").select(*cols, "shard").unionByName(rest.select(*cols, "shard"))
    return c.rank_within(c.materialize(done, "shard-done"), "shard", "u", "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    nodes = c.materialize(document_nodes(docs), "shard-docs")
    return assign(nodes, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
