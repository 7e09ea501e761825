"""Registered queries: exception labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.java import CATCH_PATTERN
from ..operators import labels as L
from ..sources import fixtures as fx
from .oracle import with_fixtures
from .registry import query

# DuckDB form of P7 (first match of the catch pattern, default Exception).
_P7_MATCH = f"regexp_extract(tgt, '{CATCH_PATTERN}', 1)"
P7_SQL = (f"CASE WHEN {_P7_MATCH} = '' THEN 'Exception' "
          f"ELSE array_to_string(string_split({_P7_MATCH}, '|'), ', ') END")


def typed_targets(spark, sf_dir):
    return L.exception_types(fx.targets(spark, sf_dir))


@query("extract_exception_types", with_fixtures(
    f"SELECT method_id, {P7_SQL} AS exception FROM targets", "targets"))
def extract_exception_types(spark, sf_dir):
    return typed_targets(spark, sf_dir).select("method_id", "exception")


@query("map_exception_label", with_fixtures(
    f"SELECT t.method_id, t.exception, CAST(coalesce(m.class_id, 0) AS INTEGER) AS label "
    f"FROM (SELECT method_id, {P7_SQL} AS exception FROM targets) t "
    f"LEFT JOIN class_map m ON t.exception = m.name", "targets", "class_map"))
def map_exception_label(spark, sf_dir):
    t = typed_targets(spark, sf_dir)
    return L.map_exception_label(t, fx.class_map(spark)).select("method_id", "exception", "label")


_COUNTS_SQL = with_fixtures(
    "SELECT exception, n, CAST(row_number() OVER (ORDER BY n DESC, first_pos) AS BIGINT) AS rank "
    "FROM (SELECT exception, count(*) AS n, min(method_id) AS first_pos FROM t GROUP BY exception)",
    "targets", ctes=(("t", f"SELECT method_id, {P7_SQL} AS exception FROM targets"),))


def exception_counts(spark, sf_dir):
    counts = L.count_exception_types(typed_targets(spark, sf_dir))
    # ranks the aggregated classes only: one row per exception class name
    order = Window.orderBy(F.desc("n"), F.asc("first_pos"))
    return counts.select("exception", "n", F.row_number().over(order).cast("long").alias("rank"))


@query("count_exception_types", _COUNTS_SQL)
def count_exception_types(spark, sf_dir):
    return exception_counts(spark, sf_dir)


@query("distinct_exception_types", with_fixtures(
    f"SELECT DISTINCT {P7_SQL} AS exception FROM targets", "targets"))
def distinct_exception_types(spark, sf_dir):
    return L.distinct_exception_types(typed_targets(spark, sf_dir))


@query("decode_class", with_fixtures(
    "SELECT b.id, b.class_id, m.name AS exception FROM "
    "(SELECT id, arg_max(class_id, struct_pack(l := logit, c := -class_id)) AS class_id FROM logits GROUP BY id) b "
    "JOIN class_map m ON b.class_id = m.class_id", "logits", "class_map"))
def decode_class(spark, sf_dir):
    from ..operators.ranking import argmax_class
    best = argmax_class(fx.logits(spark, sf_dir))
    return L.decode_class(best, fx.class_map(spark)).select("id", "class_id", "exception")


@query("first_listed_exception", with_fixtures(
    "SELECT id, string_split(string_split(value, '#')[3], ',')[1] AS exception "
    "FROM hash_records WHERE len(string_split(value, '#')) >= 4", "hash_records"))
def first_listed_exception(spark, sf_dir):
    h = fx.hash_records(spark, sf_dir).withColumn("f", F.split("value", "#"))
    return h.where(F.size("f") >= 4).select("id", L.first_listed_exception(F.col("f")).alias("exception"))


_LISTED = ("d_listed", "SELECT id, string_split(string_split(value, '#')[3], ',')[1] AS exception "
                       "FROM hash_records WHERE len(string_split(value, '#')) >= 4")


def listed_types(spark, sf_dir):
    h = fx.hash_records(spark, sf_dir).withColumn("f", F.split("value", "#"))
    return h.where(F.size("f") >= 4).select("id", L.first_listed_exception(F.col("f")).alias("exception"))


@query("map_listed_exception_label", with_fixtures(
    "SELECT d.id, d.exception, CAST(coalesce(m.class_id, 0) AS INTEGER) AS label FROM d_listed d "
    "LEFT JOIN class_map m ON m.name = d.exception", "hash_records", "class_map", ctes=(_LISTED,)))
def map_listed_exception_label(spark, sf_dir):
    """P8 + J2: label of the first listed type of a ``#`` record."""
    return L.map_exception_label(listed_types(spark, sf_dir), fx.class_map(spark))


@query("write_listed_count_report", with_fixtures(
    "SELECT row_number() OVER (ORDER BY n DESC, first_pos) - 1 AS pos, exception || ':' || n AS line FROM "
    "(SELECT exception, count(*) AS n, min(id) AS first_pos FROM d_listed GROUP BY exception)",
    "hash_records", ctes=(_LISTED,)))
def write_listed_count_report(spark, sf_dir):
    """S10 over ``#`` records: ``type:count`` lines, most frequent first."""
    from ..sources import text as TX
    counts = L.count_exception_types(listed_types(spark, sf_dir), pos_col="id")
    path = TX.write_lines(counts, F.concat_ws(":", "exception", F.col("n").cast("string")),
                          [F.desc("n"), F.asc("first_pos")], "listed_count_report")
    return TX.read_positional(spark, path, "line")


@query("corpus_counts", with_fixtures(
    "SELECT split, count(DISTINCT method_id) AS n_methods FROM code_lines GROUP BY split", "code_lines"))
def corpus_counts(spark, sf_dir):
    m = fx.methods(spark, sf_dir)
    return m.groupBy("split").agg(F.count("*").alias("n_methods"))
