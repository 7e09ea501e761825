"""Line-oriented text sources and sinks.

The reference pairs files only by line position.  Positional reads list the
part files of a path in name order and number lines from the text scan's
file/split metadata (no Python per line); pairing is then an equi-join on
the position (a sort-merge join, no broadcast).
"""

from __future__ import annotations

import re

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..session import shared_path


def write_lines(df: DataFrame, text_col: Column | str, order: list, name: str) -> str:
    """Write one text line per row in ``order`` (a total order) under the
    shared root.  The global sort range-partitions the rows, so part files in
    name order hold the lines in order; no single task sees all rows."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    col = F.col(text_col) if isinstance(text_col, str) else text_col
    df.orderBy(*order).select(col.cast("string").alias("value")).write.text(path)
    return path


def _part_files(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isFile():
        return [path]
    names = [s.getPath().toString() for s in fs.listStatus(p)
             if s.isFile() and not s.getPath().getName().startswith(("_", "."))]

    def place(name: str) -> tuple:
        # part numbers past 99999 have a digit more, so they compare as numbers
        part = re.search(r"/part-(\d+)[^/]*$", name)
        return (0, int(part.group(1)), name) if part else (1, 0, name)
    return sorted(names, key=place)


def read_positional(spark: SparkSession, path: str, col: str = "value") -> DataFrame:
    """Lines of a text file (or of a directory's part files in name order)
    with their 0-based position: ``pos``, ``col``.

    JVM only: the text scan's hidden ``_metadata`` columns give each line's
    file and split; ``monotonically_increasing_id`` gives its order inside the
    scan partition.  The scan is written once so these ids are fixed; then
    per-split line counts (one row per split) give prefix offsets in (file name,
    split start) order: splits are sorted into ranges, summed inside a range and
    over the ranges, so no task holds all splits.
    """
    from ..operators.util import materialize
    files = _part_files(spark, path)
    scan = spark.read.text(files).select(
        F.col("value").alias(col),
        F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_mid"))
    x = materialize(scan, "lines")
    blocks = x.groupBy("_f", "_b").agg(F.min("_mid").alias("_first"), F.count("*").alias("_n"))
    ranged = materialize(blocks.orderBy("_f", "_b").withColumn("_r", F.spark_partition_id()), "splits")
    sizes = ranged.groupBy("_r").agg(F.sum("_n").alias("_t"))            # one row per range
    ahead = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_r", F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_r").orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(bases, "_r")
    # the optimizer broadcasts the offsets while they are small
    return x.join(offsets.select("_f", "_b", "_first", (F.col("_base") + F.col("_in")).alias("_off")), ["_f", "_b"]).select(
        (F.col("_off") + F.col("_mid") - F.col("_first")).cast("long").alias("pos"), col)


def positional_join(frames: list[DataFrame], how: str = "inner") -> DataFrame:
    """Pair positional frames on ``pos``; inner drops the surplus of the longer."""
    return reduce(lambda a, b: a.join(b, "pos", how), frames)


def read_parallel_corpus(spark: SparkSession, src_path: str, tgt_path: str) -> DataFrame:
    """Line i of src with line i of tgt (``zip`` semantics)."""
    return positional_join([read_positional(spark, src_path, "src"),
                            read_positional(spark, tgt_path, "tgt")])


def read_training_triples(spark: SparkSession, in_try: str, before_try: str, labels: str) -> DataFrame:
    """S3: (pos, in_try, before_try, label), stripped, label as int.

    Rows follow the in-try file; a missing partner line is an error, as the
    reference's index lookup would be (``assert_true``)."""
    a = read_positional(spark, in_try, "in_try")
    b = read_positional(spark, before_try, "before_try")
    c = read_positional(spark, labels, "label_text")
    j = positional_join([a, b, c], "left")
    ok = F.assert_true(F.col("before_try").isNotNull() & F.col("label_text").isNotNull(),
                       F.lit("training files differ in length"))
    return j.select("pos", F.when(ok.isNull(), py_strip(F.col("in_try"))).alias("in_try"),
                    py_strip(F.col("before_try")).alias("before_try"),
                    py_strip(F.col("label_text")).cast("int").alias("label"))


def read_nonblank_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines with blanks removed (order by ``pos``)."""
    x = read_positional(spark, path).select("pos", py_strip(F.col("value")).alias("line"))
    return x.where(F.col("line") != "")


def read_label_map(spark: SparkSession, path: str, int_values: bool = True) -> DataFrame:
    """``key:value`` lines -> (name, value); blanks skipped; a repeated key
    keeps its last value; a line without exactly one ``:`` is an error.

    A label map is a small file, so each file is read as one row and its lines
    are numbered there; several files follow each other by name."""
    whole = spark.read.option("wholetext", True).text(path)
    lines = whole.select(F.col("_metadata.file_path").alias("_f"), F.posexplode(F.split("value", "\r\n|\r|\n", -1)).alias("_i", "_l"))
    x = lines.withColumn("_l", py_strip(F.col("_l"))).where("_l <> ''").withColumn("_kv", F.split("_l", ":", -1))
    whole_key = F.assert_true(F.size("_kv") == 2, F.lit("label map line needs key:value"))
    x = x.select(F.struct("_f", "_i").alias("pos"), F.when(whole_key.isNull(), F.col("_kv")).alias("_kv"))
    value = F.col("_kv")[1]
    value = F.trim(value).cast("int") if int_values else value
    return x.select("pos", F.col("_kv")[0].alias("name"), value.alias("value")) \
            .groupBy("name").agg(F.max_by("value", "pos").alias("value"))


def read_hash_records(spark: SparkSession, path: str) -> DataFrame:
    """``#`` records as typed rows; records with fewer than 4 fields skipped."""
    from ..operators.spans import parse_hash_record
    x = spark.read.text(path).select(parse_hash_record(F.col("value")).alias("r"))
    return x.where(F.col("r").isNotNull()).select("r.*")


def export_parallel_text(df: DataFrame, columns: list[str], order: list, name: str) -> dict[str, str]:
    """S8 text export: one text file set per column, line i of every file from
    the same row (rows in ``order``, a total order).  Returns column -> path.
    Read back with ``read_positional`` + ``positional_join``.  Values must not
    contain line breaks (token text joined by spaces never does)."""
    return {c: write_lines(df, c, order, f"{name}-{c}") for c in columns}
