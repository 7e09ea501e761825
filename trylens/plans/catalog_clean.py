"""Registered queries: cleaning, extraction, filters and line splits.

P1-P6, P9, F1, F3, A16, S1, S13, E1, E2, E8, E9.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import comma_list, json_int_list, pad_to
from ..functions.java import is_identifier
from ..operators import spans as SP
from ..sources import fixtures as fx
from ..sources import tables
from . import oracle_exprs as X
from .oracle import with_fixtures
from .registry import query

WS = X.WS


@query("normalize_code_whitespace", with_fixtures(
    f"SELECT method_id, line_no, replace(replace(regexp_replace(line, '{WS}*([().]){WS}*', '\\1', 'g'), "
    "chr(13), ' '), chr(9), ' ') AS line FROM code_lines", "code_lines"))
def normalize_code_whitespace(spark, sf_dir):
    cl = fx.code_lines(spark, sf_dir)
    return cl.select("method_id", "line_no", T.normalize_code_whitespace(F.col("line")).alias("line"))


@query("clean_method_source", with_fixtures(
    f"SELECT method_id, {X.clean_src('src')} AS src FROM methods", "methods"))
def clean_method_source(spark, sf_dir):
    m = fx.methods(spark, sf_dir)
    return m.select("method_id", T.clean_method_source(F.col("src")).alias("src"))


def _rename_sql(line: str) -> str:
    t = f"replace(replace(replace({X.lstrip(line)}, '    ', ' '), '   ', ' '), '  ', ' ')"
    w = f"string_split({X.lstrip(t)}, ' ')"
    return (f"(CASE WHEN len({w}) > 2 AND {w}[3] IN ('=', ';') THEN array_to_string(list_transform({w}, "
            f"lambda wd, wi: CASE WHEN wi = 2 THEN lower(substring({w}[1], 1, 1)) || substring({w}[1], 2) "
            f"ELSE wd END), ' ') ELSE {t} END)")


@query("rename_declared_variables", with_fixtures(
    f"SELECT method_id, line_no, {_rename_sql(X.strip('line'))} AS line FROM code_lines", "code_lines"))
def rename_declared_variables(spark, sf_dir):
    cl = fx.code_lines(spark, sf_dir)
    return cl.select("method_id", "line_no",
                     T.rename_declared_variables(T.py_strip(F.col("line"))).alias("line"))


@query("wrap_full_method", with_fixtures(
    f"SELECT method_id, {X.clean_src('src')} || tgt || chr(10) || ' }}' AS func FROM methods", "methods"))
def wrap_full_method(spark, sf_dir):
    m = fx.methods(spark, sf_dir)
    return m.select("method_id", T.wrap_full_method(T.clean_method_source(F.col("src")),
                                                    F.col("tgt")).alias("func"))


_SPAN_SQL = ("d_span", """SELECT method_id, lines, preds, b AS "begin",
 CASE WHEN b > 0 AND coalesce(list_position(list_slice(preds, b + 2, len(preds)), 0), 0) > 0
      THEN b + list_position(list_slice(preds, b + 2, len(preds)), 0) - 1 ELSE len(preds) END AS "end"
 FROM (SELECT method_id, lines, preds, coalesce(list_position(preds, 1), 0) - 1 AS b FROM methods)""")


@query("find_predicted_span", with_fixtures(
    'SELECT method_id, CAST("begin" AS INTEGER) AS "begin", CAST("end" AS INTEGER) AS "end" FROM d_span',
    "methods", ctes=(_SPAN_SQL,)))
def find_predicted_span(spark, sf_dir):
    m = fx.methods(spark, sf_dir)
    return m.select("method_id", SP.find_predicted_span(F.col("preds")).alias("s")) \
            .select("method_id", "s.begin", "s.end")


def _ins_sql() -> str:
    def sl(a, b):
        return f"array_to_string({X.py_slice('lines', a, b)}, chr(10))"
    return (f"{sl('0', '\"begin\"')} || chr(10) || 'try {{' || chr(10) || {sl('\"begin\"', '\"end\" + 1')} "
            f"|| chr(10) || '}} catch ( Exception e ) {{ }} ' || chr(10) || {sl('\"end\" + 1', None)}")


@query("insert_try_block", with_fixtures(
    f"SELECT method_id, {_ins_sql()} AS code FROM d_span", "methods", ctes=(_SPAN_SQL,)))
def insert_try_block(spark, sf_dir):
    m = fx.methods(spark, sf_dir)
    x = m.select("method_id", "lines", SP.find_predicted_span(F.col("preds")).alias("s"))
    return x.select("method_id", SP.insert_try_block(F.col("lines"), F.col("s.begin"),
                                                     F.col("s.end")).alias("code"))


_HASH_SQL = ("d_hash", """SELECT id, f, string_split(f[2], ',') AS toks,
 CAST(trim(string_split(f[4], ',')[1]) AS INTEGER) AS b,
 CAST(trim(replace(string_split(f[4], ',')[2], chr(10), '')) AS INTEGER) AS e
 FROM (SELECT id, string_split(value, '#') AS f FROM hash_records) WHERE len(f) >= 4""")


@query("parse_hash_record", with_fixtures(
    f"SELECT id, replace(f[1], ',', ' ') || ' ' || array_to_string({X.py_slice('toks', '0', 'b')}, ' ') AS front, "
    f"array_to_string({X.py_slice('toks', 'b', 'e + 1')}, ' ') AS back, "
    f"string_split(f[3], ',')[1] AS exception, b AS \"begin\", e AS \"end\" FROM d_hash",
    "hash_records", ctes=(_HASH_SQL,)))
def parse_hash_record(spark, sf_dir):
    h = fx.hash_records(spark, sf_dir).select("id", SP.parse_hash_record(F.col("value")).alias("r"))
    return h.where(F.col("r").isNotNull()).select("id", "r.front", "r.back", "r.exception",
                                                  "r.begin", "r.end")


@query("filter_min_fields", with_fixtures(
    "SELECT id, value FROM hash_records WHERE len(string_split(value, '#')) >= 4", "hash_records"))
def filter_min_fields(spark, sf_dir):
    h = fx.hash_records(spark, sf_dir)
    return h.where(F.size(F.split("value", "#", -1)) >= 4)


@query("resplit_tokens", with_fixtures(
    f"SELECT method_id, array_to_string(flatten(list_transform({X.split_ws('src')}, lambda tk: "
    "CASE WHEN length(tk) > 2 THEN regexp_extract_all(tk, '(\\w+|[.])') ELSE [tk] END)), ' ') AS tokens "
    "FROM methods", "methods"))
def resplit_tokens(spark, sf_dir):
    m = fx.methods(spark, sf_dir)
    return m.select("method_id", F.array_join(T.resplit_tokens(T.py_split(F.col("src"))), " ").alias("tokens"))


@query("filter_identifiers", with_fixtures(
    f"SELECT method_id, array_to_string(list_filter({X.split_ws('src')}, lambda tk: {X.is_ident('tk')}), ' ') "
    "AS identifiers FROM methods", "methods"))
def filter_identifiers(spark, sf_dir):
    m = fx.methods(spark, sf_dir)
    return m.select("method_id", F.array_join(F.filter(T.py_split(F.col("src")), is_identifier),
                                              " ").alias("identifiers"))


@query("split_code_lines", with_fixtures(
    "SELECT method_id, CAST(line_no - 1 AS INTEGER) AS line_idx, line FROM code_lines", "code_lines"))
def split_code_lines(spark, sf_dir):
    m = fx.methods(spark, sf_dir).select("method_id", F.array_join("lines", "\n").alias("code"))
    return m.select("method_id", F.posexplode(F.split("code", "\n", -1)).alias("line_idx", "line"))


@query("read_method_corpus", with_fixtures(
    "SELECT method_id, split, line_no, line, label FROM code_lines", "code_lines"))
def read_method_corpus(spark, sf_dir):
    m = fx.methods(spark, sf_dir).select("method_id", "lines", "labels", "split")
    path = tables.write_table(m, tables.shared_path(spark, "method_corpus"), ("split",))
    return tables.method_lines(tables.read_method_corpus(spark, path))


_FIX_SQL = ("d_fix", """SELECT method_id,
 list_slice(list_concat(lines, list_transform(range(50), lambda x: '[PAD]')), 1, 50) AS l50,
 list_slice(list_concat(lines, list_transform(range(8), lambda x: '[PAD]')), 1, 8) AS l8,
 list_slice(list_concat(labels, list_transform(range(50), lambda x: 0)), 1, 50) AS b50,
 list_slice(list_concat(labels, list_transform(range(8), lambda x: 0)), 1, 8) AS b8 FROM methods""")


@query("fix_line_count", with_fixtures(
    "SELECT method_id, array_to_string(l50, chr(10)) AS lines_50, array_to_string(l8, chr(10)) AS lines_8 FROM d_fix",
    "methods", ctes=(_FIX_SQL,)))
def fix_line_count(spark, sf_dir):
    m = fx.methods(spark, sf_dir)
    return m.select("method_id", F.array_join(pad_to(F.col("lines"), 50, "[PAD]"), "\n").alias("lines_50"),
                    F.array_join(pad_to(F.col("lines"), 8, "[PAD]"), "\n").alias("lines_8"))


@query("fix_label_count", with_fixtures(
    "SELECT method_id, array_to_string(b50, ',') AS labels_50, array_to_string(b8, ',') AS labels_8 FROM d_fix",
    "methods", ctes=(_FIX_SQL,)))
def fix_label_count(spark, sf_dir):
    m = fx.methods(spark, sf_dir)
    return m.select("method_id", comma_list(pad_to(F.col("labels"), 50, 0)).alias("labels_50"),
                    comma_list(pad_to(F.col("labels"), 8, 0)).alias("labels_8"))


@query("join_line_predictions", with_fixtures(
    "SELECT method_id, array_to_string(preds, ',') AS line_predict FROM methods", "methods"))
def join_line_predictions(spark, sf_dir):
    m = fx.methods(spark, sf_dir)
    return m.select("method_id", comma_list(F.col("preds")).alias("line_predict"))


@query("mask_to_json", with_fixtures(
    f"SELECT method_id, {X.json_list('labels')} AS labels_json FROM methods", "methods"))
def mask_to_json(spark, sf_dir):
    m = fx.methods(spark, sf_dir)
    return m.select("method_id", json_int_list(F.col("labels")).alias("labels_json"))
