"""Registered queries: text and table sources/sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from ..sources import fixtures as fx
from ..sources import tables
from ..sources import text as TX
from . import oracle_exprs as X
from .catalog_labels import P7_SQL, exception_counts
from .oracle import with_fixtures
from .registry import query


@query("read_parallel_corpus", with_fixtures(
    "SELECT row_number() OVER (ORDER BY method_id) - 1 AS pos, src, tgt FROM methods", "methods"))
def read_parallel_corpus(spark, sf_dir):
    m = fx.methods(spark, sf_dir)
    src = TX.write_lines(m, "src", ["method_id"], "src")
    tgt = TX.write_lines(m, "tgt", ["method_id"], "tgt")
    return TX.read_parallel_corpus(spark, src, tgt)


@query("positional_join", with_fixtures(
    """SELECT a.pos, a.src, b.tgt FROM (SELECT row_number() OVER (ORDER BY method_id) - 1 AS pos, src FROM methods) a
 JOIN (SELECT row_number() OVER (ORDER BY method_id) - 1 AS pos, tgt FROM methods WHERE split = 'train') b ON a.pos = b.pos""",
    "methods"))
def positional_join(spark, sf_dir):
    m = fx.methods(spark, sf_dir)
    src = TX.write_lines(m, "src", ["method_id"], "src")
    tgt = TX.write_lines(m.where(F.col("split") == "train"), "tgt", ["method_id"], "tgt_train")
    return TX.positional_join([TX.read_positional(spark, src, "src"), TX.read_positional(spark, tgt, "tgt")])


@query("read_training_triples", with_fixtures(
    f"""SELECT row_number() OVER (ORDER BY t.method_id) - 1 AS pos, {X.strip('t.tgt')} AS in_try,
 {X.strip('m.src')} AS before_try, CAST(coalesce(c.class_id, 0) AS INTEGER) AS label
 FROM (SELECT method_id, tgt, {P7_SQL} AS exception FROM targets) t JOIN methods m ON m.method_id = t.method_id
 LEFT JOIN class_map c ON c.name = t.exception""", "methods", "class_map"))
def read_training_triples(spark, sf_dir):
    m = fx.methods(spark, sf_dir)
    lab = L.map_exception_label(L.exception_types(m), fx.class_map(spark))
    in_try = TX.write_lines(lab, "tgt", ["method_id"], "in_try")
    before = TX.write_lines(lab, "src", ["method_id"], "before_try")
    labels = TX.write_lines(lab, "label", ["method_id"], "labels")
    return TX.read_training_triples(spark, in_try, before, labels)


@query("read_hash_records", with_fixtures(
    f"""SELECT f[1] AS method_input, array_to_string(toks, ',') AS tokens, string_split(f[3], ',')[1] AS exception,
 b AS "begin", e AS "end", replace(f[1], ',', ' ') || ' ' || array_to_string({X.py_slice('toks', '0', 'b')}, ' ') AS front,
 array_to_string({X.py_slice('toks', 'b', 'e + 1')}, ' ') AS back FROM (
 SELECT f, string_split(f[2], ',') AS toks, CAST(trim(string_split(f[4], ',')[1]) AS INTEGER) AS b,
  CAST(trim(replace(string_split(f[4], ',')[2], chr(10), '')) AS INTEGER) AS e
 FROM (SELECT string_split(value, '#') AS f FROM hash_records) WHERE len(f) >= 4)""", "hash_records"))
def read_hash_records(spark, sf_dir):
    h = fx.hash_records(spark, sf_dir)
    path = TX.write_lines(h, "value", ["id"], "hash_records")
    r = TX.read_hash_records(spark, path)
    return r.select("method_input", F.array_join("tokens", ",").alias("tokens"), "exception", "begin", "end",
                    "front", "back")


def _label_file(spark, sf_dir):
    """A ``key:value`` file: the type-count report, a blank line, then the
    class map (so mapped keys repeat and the class id must win)."""
    counts = exception_counts(spark, sf_dir).select(
        F.lit(0).alias("part"), F.col("rank").cast("long").alias("k"),
        F.concat_ws(":", "exception", F.col("n").cast("string")).alias("line"))
    blank = spark.range(1).select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("k"), F.lit("  ").alias("line"))
    cmap = fx.class_map(spark).select(F.lit(2).alias("part"), F.col("class_id").cast("long").alias("k"),
                                      F.concat_ws(":", "name", F.col("class_id").cast("string")).alias("line"))
    allx = counts.unionByName(blank).unionByName(cmap)
    return TX.write_lines(allx, "line", ["part", "k"], "label_map")


_COUNT_LINES = ("d_cnt", f"""SELECT exception, count(*) AS n, min(method_id) AS first_pos FROM (
 SELECT method_id, {P7_SQL} AS exception FROM targets) GROUP BY exception""")


@query("read_label_map", with_fixtures(
    """SELECT coalesce(c.name, d.exception) AS name, CAST(coalesce(c.class_id, d.n) AS INTEGER) AS value
 FROM d_cnt d FULL JOIN class_map c ON c.name = d.exception""", "targets", "class_map", ctes=(_COUNT_LINES,)))
def read_label_map(spark, sf_dir):
    return TX.read_label_map(spark, _label_file(spark, sf_dir))


@query("read_nonblank_lines", f"""SELECT line FROM (
 SELECT {X.strip('unnest(regexp_split_to_array(text, chr(13) || chr(10) || \'|\' || chr(13) || \'|\' || chr(10)))')} AS line
 FROM documents) WHERE line <> ''""")
def read_nonblank_lines(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    path = TX.write_lines(d, "text", ["doc_id"], "documents")
    return TX.read_nonblank_lines(spark, path).select("line")


@query("write_count_report", with_fixtures(
    "SELECT row_number() OVER (ORDER BY n DESC, first_pos) - 1 AS pos, exception || ':' || n AS line FROM d_cnt",
    "targets", ctes=(_COUNT_LINES,)))
def write_count_report(spark, sf_dir):
    counts = exception_counts(spark, sf_dir)
    path = TX.write_lines(counts, F.concat_ws(":", "exception", F.col("n").cast("string")), ["rank"], "count_report")
    return TX.read_positional(spark, path, "line")


@query("write_labels", with_fixtures(
    f"""SELECT t.method_id, CASE WHEN t.method_id % 10 < 8 THEN 'train' WHEN t.method_id % 10 = 8 THEN 'valid' ELSE 'test' END AS split,
 CAST(coalesce(c.class_id, 0) AS INTEGER) AS label FROM (SELECT method_id, {P7_SQL} AS exception FROM targets) t
 LEFT JOIN class_map c ON c.name = t.exception""", "targets", "class_map"))
def write_labels(spark, sf_dir):
    t = L.map_exception_label(L.exception_types(fx.targets(spark, sf_dir)), fx.class_map(spark))
    t = t.withColumn("split", fx._split_of(F.col("method_id")))
    return tables.write_and_read(spark, t.select("method_id", "split", "label"), "labels", ("split",))


@query("append_feedback", with_fixtures("SELECT * FROM feedback", "feedback"))
def append_feedback(spark, sf_dir):
    fb = fx.feedback(spark, sf_dir)
    path = tables.shared_path(spark, "feedback")
    tables.append_feedback(fb.where(F.col("record_id") % 2 == 0), path)
    tables.append_feedback(fb.where(F.col("record_id") % 2 == 1), path)
    return tables.read_feedback(spark, path)


@query("read_feedback", with_fixtures(
    "SELECT * FROM feedback", "feedback"))
def read_feedback(spark, sf_dir):
    path = tables.shared_path(spark, "feedback")
    tables.append_feedback(fx.feedback(spark, sf_dir), path)
    return tables.read_feedback(spark, path)
