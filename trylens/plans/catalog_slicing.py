"""Registered queries: try-block slicing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import slicing as S
from ..sources import fixtures as fx
from ..sources import tables
from . import oracle_exprs as X
from .catalog_labels import P7_SQL
from .oracle import with_fixtures
from .registry import query

# --- DuckDB chain shared by the oracle queries ------------------------------
_D_TOKENS = ("d_tok", f"SELECT method_id, split, tgt, {X.split_ws(X.clean_src('src'))} AS toks FROM methods")
_D_TRY = ("d_try", f"SELECT *, {X.last_marker('toks', 'try')} AS try_idx FROM d_tok")
_D_FB = ("d_fb", f"SELECT *, {X.py_slice('toks', None, 'try_idx')} AS front, "
                 f"{X.py_slice('toks', 'try_idx', None)} AS back FROM d_try")
_D_ST = ("d_st", f"SELECT *, {X.intervals(X.statements('front'))} AS stmts, {X.seeds('back')} AS seeds0 FROM d_fb")
_D_KEPT = ("d_kept", f"SELECT *, {X.kept('front', 'stmts', 'seeds0')} AS kept FROM d_st")
_D_MASK = ("d_mask", f"SELECT *, {X.mask('front', 'stmts', 'kept')} AS mask FROM d_kept")
_CHAIN = (_D_TOKENS, _D_TRY, _D_FB, _D_ST, _D_KEPT, _D_MASK)


def _oracle(body: str, upto: int) -> str:
    return with_fixtures(body, "methods", ctes=_CHAIN[:upto])


def sliced(spark, sf_dir):
    m = fx.methods(spark, sf_dir)
    return S.slice_methods(m, keep=("method_id", "split", "tgt"))


@query("last_try_index", _oracle("SELECT method_id, try_idx FROM d_try", 2))
def last_try_index(spark, sf_dir):
    m = fx.methods(spark, sf_dir)
    parts = S.split_at_try(S.source_tokens(F.col("src")))
    return m.select("method_id", parts["try_idx"].alias("try_idx"))


@query("split_front_back", _oracle(
    f"SELECT method_id, try_idx, {X.join_sp('front')} AS front, {X.join_sp('back')} AS back FROM d_fb", 3))
def split_front_back(spark, sf_dir):
    m = fx.methods(spark, sf_dir)
    x = m.select("method_id", S.split_at_try(S.source_tokens(F.col("src"))).alias("p"))
    return x.select("method_id", "p.try_idx", F.array_join("p.front", " ").alias("front"),
                    F.array_join("p.back", " ").alias("back"))


@query("segment_statements", _oracle(f"SELECT method_id, {X.iv_text('stmts')} AS statements FROM d_st", 4))
def segment_statements(spark, sf_dir):
    s = S.method_statements(fx.methods(spark, sf_dir), keep=("method_id",))
    return s.select("method_id", F.array_join(F.transform(
        "statements", lambda iv: F.concat_ws("-", iv["s"].cast("string"), iv["e"].cast("string"))),
        ",").alias("statements"))


@query("slice_seeds", _oracle(
    "SELECT method_id, array_to_string(list_sort(seeds0), ' ') AS seeds FROM d_st", 4))
def slice_seeds(spark, sf_dir):
    s = S.method_seeds(fx.methods(spark, sf_dir), keep=("method_id",))
    return s.select("method_id", F.array_join(F.array_sort("seeds"), " ").alias("seeds"))


@query("backward_slice_mask", _oracle(
    f"SELECT method_id, {X.join_sp('front')} AS front, {X.join_sp('back')} AS back, "
    f"{X.json_list('mask')} AS mask FROM d_mask", 6))
def backward_slice_mask(spark, sf_dir):
    return S.sliced_output(sliced(spark, sf_dir)).select("method_id", "front", "back", "mask")


@query("slice_quality_gate", _oracle(
    "SELECT method_id, CAST(list_sum(mask) AS INTEGER) AS mask_sum, "
    "coalesce(list_sum(mask), 0) > 1 AND len(mask) = len(front) AS valid FROM d_mask", 6))
def slice_quality_gate(spark, sf_dir):
    s = sliced(spark, sf_dir)
    return s.select("method_id", S.mask_sum(F.col("mask")).alias("mask_sum"),
                    S.quality_gate(F.col("mask"), F.col("front")).alias("valid"))


_MARK_CATCH = ("d_catch", f"""SELECT method_id, {X.last_marker(
    "list_concat(list_transform(" + X.split_ws('src') + ", lambda tk: CASE WHEN tk = 'try' THEN 'TRY' ELSE tk END), "
    "list_transform(" + X.split_ws('tgt') + ", lambda tk: CASE WHEN tk = 'catch' THEN 'CatchClause' ELSE tk END))",
    'CatchClause')} AS catch_idx FROM methods""")


@query("missing_marker_check", with_fixtures(
    "SELECT t.split, count(*) AS n, count(*) FILTER (WHERE t.try_idx < 0) AS n_no_try, "
    "count(*) FILTER (WHERE t.try_idx = 0) AS n_try_at_0, count(*) FILTER (WHERE c.catch_idx < 0) AS n_no_catch, "
    "count(*) FILTER (WHERE c.catch_idx = 0) AS n_catch_at_0 "
    "FROM d_try t JOIN d_catch c ON c.method_id = t.method_id GROUP BY t.split",
    "methods", ctes=(_MARK_CATCH, _D_TOKENS, _D_TRY)))
def missing_marker_check(spark, sf_dir):
    """per split, rows with no try (A6) or no catch marker (A8), and the
    rows where the marker is at index 0 (the reference's ``if not idx`` test
    fires there instead of at -1)."""
    from ..operators.structure import marker_tokens
    from ..functions.folds import last_marker_index
    m = fx.methods(spark, sf_dir)
    x = m.select("split", S.split_at_try(S.source_tokens(F.col("src")))["try_idx"].alias("try_idx"),
                 last_marker_index(marker_tokens(F.col("src"), F.col("tgt")), "CatchClause").alias("catch_idx"))
    return x.groupBy("split").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("try_idx") < 0, 1)).alias("n_no_try"),
        F.count(F.when(F.col("try_idx") == 0, 1)).alias("n_try_at_0"),
        F.count(F.when(F.col("catch_idx") < 0, 1)).alias("n_no_catch"),
        F.count(F.when(F.col("catch_idx") == 0, 1)).alias("n_catch_at_0"))


@query("explode_method_statements", _oracle(
    "SELECT method_id, CAST(k - 1 AS INTEGER) AS stmt_no, stmts[k].s AS start, stmts[k].e AS \"end\", "
    "array_to_string(list_slice(front, stmts[k].s + 1, stmts[k].e + 1), ' ') AS text "
    "FROM d_st, range(1, len(stmts) + 1) r(k)", 4))
def explode_method_statements(spark, sf_dir):
    return S.explode_statements(S.method_statements(fx.methods(spark, sf_dir), keep=("method_id",)))


@query("write_sliced_corpus", with_fixtures(
    f"SELECT d.method_id, d.split, {X.join_sp('front')} AS front, {X.join_sp('back')} AS back, "
    f"{X.json_list('mask')} AS mask, {X.join_sp('toks')} AS source, d.tgt, CAST(coalesce(c.class_id, 0) AS INTEGER) AS label "
    f"FROM d_mask d LEFT JOIN class_map c ON c.name = ({P7_SQL.replace('tgt', 'd.tgt')})",
    "methods", "class_map", ctes=_CHAIN))
def write_sliced_corpus(spark, sf_dir):
    from ..operators import labels as L
    x = sliced(spark, sf_dir).withColumn("source", F.array_join(F.concat("front", "back"), " "))
    s = S.sliced_output(x)
    s = L.map_exception_label(L.exception_types(s), fx.class_map(spark))
    out = s.select("method_id", "split", "front", "back", "mask", "source", "tgt", "label")
    return tables.write_and_read(spark, out, "sliced_corpus", partition_by=("split",))
