"""End-to-end data flows built from the operators.

``task1_corpus``: methods -> tagged, merged, fixed-length, renamed lines (the
line-model input), in Arrow batches.  ``task2_corpus``: methods + targets ->
front/back token streams with labels (the type-model input).  Both are single
passes over the method table, the second with broadcast lookups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.streams import line_corpus
from ..functions.text import clean_method_source, wrap_full_method
from ..operators import labels as L
from ..operators import structure as A
from ..operators.encode import PAD_LINE

LINE_LIMIT = 50
WORD_MAX = 64
TEXT_MAX = 256


def task1_corpus(methods: DataFrame, line_limit: int = LINE_LIMIT) -> DataFrame:
    """method_id, split, lines_count, lines (fixed length), labels (fixed length).

    Methods that do not parse (unbalanced braces) or merge to no lines are
    dropped (F2).  lines_count is taken before cutting (E3).
    """
    x = methods.select("method_id", "split", "lines", "labels", "src")
    of = x.schema
    schema = T.StructType([of["method_id"], of["split"], T.StructField("lines_count", T.IntegerType()),
                           of["lines"], of["labels"]])
    return x.mapInArrow(line_corpus(A.LINE_KIND_RULES, line_limit, PAD_LINE), schema)


def task2_corpus(methods: DataFrame, label_map: DataFrame) -> DataFrame:
    """method_id, split, front, back (marker token arrays), exception, label.

    Front/back follow the marker split (A7, A8, A10) of the source with
    ``try`` -> TRY and the target with ``catch`` -> CatchClause.
    """
    x = methods.select("method_id", "split", "tgt",
                       A.split_front_back_at_catch(A.marker_tokens(F.col("src"), F.col("tgt"))).alias("s"))
    x = x.select("method_id", "split", "tgt", "s.front", "s.back")
    return L.map_exception_label(L.exception_types(x), label_map).drop("tgt")


def task2_texts(methods: DataFrame, label_map: DataFrame) -> DataFrame:
    """method_id, split, src, tgt, label: what ``read_front_back`` makes the front
    and back tokens of ``task2_corpus`` from."""
    x = methods.select("method_id", "split", "src", "tgt")
    return L.map_exception_label(L.exception_types(x), label_map).drop("exception")


def task2_sources(methods: DataFrame) -> DataFrame:
    """P2 + P4 + A5/A4: the full method text for the AST-style token stream."""
    func = wrap_full_method(clean_method_source(F.col("src")), F.col("tgt"))
    return methods.select("method_id", "split", "tgt", A.repair_unclosed_method(func).alias("r"))


# --- online prediction (L5) --------------------------------------------------

def line_feature_docs(methods: DataFrame, lines_col: str = "lines") -> DataFrame:
    """Per line: line_key = (method_id, line_no), both columns, tokens (the tagged
    and renamed line + previous/next context), plus ``split`` and ``label`` when
    the input has them."""
    has_labels = "labels" in methods.columns
    feats = A.line_words_in_context(F.col(lines_col))
    zipped = F.arrays_zip(feats.alias("f"), F.col("labels").alias("l")) if has_labels else \
        F.transform(feats, lambda f: F.struct(f.alias("f")))
    keep = [c for c in ("split",) if c in methods.columns]
    x = methods.select("method_id", *keep, F.posexplode(zipped).alias("i", "z"))
    line_no = (F.col("i") + 1).cast("int")
    return x.select(F.struct("method_id", line_no.alias("line_no")).alias("line_key"), "method_id",
                    line_no.alias("line_no"), *keep,
                    *([F.col("z.l").alias("label")] if has_labels else []), F.col("z.f").alias("tokens"))


def fit_line_model(methods: DataFrame) -> DataFrame:
    """L3 on the lines of ``methods``: the features of ``line_feature_docs``, made
    and counted from the methods' rows."""
    from ..operators import models as M
    return M.fit_naive_bayes(methods, "labels", "lines", read=A.read_line_words_in_context)


def score_lines(methods: DataFrame, model) -> DataFrame:
    """L4: (method_id, line_no, scores, class_id) of every line, on the same features."""
    from ..operators import models as M
    return M.class_scores(methods, model, "method_id", "lines", A.read_line_words_in_context, "line_no")


def ast_type_texts(methods: DataFrame, label_map: DataFrame) -> DataFrame:
    """Type-model training rows on the AST-style stream: split, func (P2 + P4), label.
    ``read_repaired_method`` makes the tokens: A5/A4, then the TRY/CatchClause
    split (A7, A8, A10), prefixed f:/b:."""
    func = wrap_full_method(clean_method_source(F.col("src")), F.col("tgt"))
    x = methods.select("method_id", "split", "tgt", func.alias("func"))
    return L.map_exception_label(L.exception_types(x), label_map).select("method_id", "split", "func", "label")


def ast_corpus(methods: DataFrame, label_map: DataFrame) -> DataFrame:
    """The front/back corpus on the AST-style stream (S8): method_id, split,
    front, back, source (cleaned source tokens), tgt, label."""
    from ..functions.text import py_split
    func = wrap_full_method(clean_method_source(F.col("src")), F.col("tgt"))
    x = methods.select("method_id", "split", "tgt",
                       F.array_join(py_split(clean_method_source(F.col("src"))), " ").alias("source"),
                       A.split_front_back_at_catch(A.repair_unclosed_method(func)["tokens"]).alias("s"))
    x = x.select("method_id", "split", F.array_join("s.front", " ").alias("front"),
                 F.array_join("s.back", " ").alias("back"), "source", "tgt")
    return L.map_exception_label(L.exception_types(x), label_map).drop("exception")


def fit_handler_models(methods: DataFrame, label_map: DataFrame):
    """Line model (L3) and type model (L1) from the training split."""
    from ..operators import models as M
    from ..operators.util import materialize
    train = methods.where(F.col("split") == "train")
    # a fit reads its documents once, so they are not written
    line_model = materialize(fit_line_model(train))
    type_model = materialize(M.fit_naive_bayes(ast_type_texts(train, label_map), tokens="func", read=A.read_repaired_method))
    return line_model, type_model


def predict_handlers(submissions: DataFrame, line_model: DataFrame, type_model: DataFrame,
                     label_map: DataFrame, line_limit: int = LINE_LIMIT) -> DataFrame:
    """(method_id, code) -> reply columns and the feedback record fields.

    S13 split -> A3 tags -> P3 renaming -> L4 line scores of every line, padded
    to 50 predictions (E1; longer methods keep all of theirs) -> A16 span -> P5 try
    insertion -> P2 + A5/A4 tokens -> A7/A8/A10 split -> L2 type -> J3 decode.
    The type defaults to ``Exception``.
    """
    from ..functions.arrays import comma_list
    from ..functions.text import clean_method_source
    from ..operators import models as M
    from ..operators.spans import find_predicted_span, insert_try_block
    from ..operators.util import materialize

    sub = submissions.select("method_id", "code", F.split("code", "\n", -1).alias("lines"))
    per_line = score_lines(sub, line_model)
    preds = per_line.groupBy("method_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "class_id"))),
                    lambda s: s["class_id"].cast("int")).alias("preds"))
    x = sub.join(preds, "method_id", "left").withColumn(
        "preds", F.coalesce(F.col("preds"), F.array().cast("array<int>")))
    x = x.withColumn("preds", F.concat("preds", F.array_repeat(
        F.lit(0), F.greatest(F.lit(0), F.lit(line_limit) - F.size("preds")))))
    x = x.withColumn("span", find_predicted_span(F.col("preds")))
    x = x.withColumn("with_try", insert_try_block(F.col("lines"), F.col("span.begin"), F.col("span.end")))
    x = materialize(x.select("method_id", "code", "preds", "span", clean_method_source(F.col("with_try")).alias("func")))
    typ = M.class_scores(x, type_model, "method_id", "func", A.read_repaired_method).select("method_id", "class_id")
    named = L.decode_class(typ, label_map).select("method_id", F.col("exception").alias("_type"))
    out = x.join(named, "method_id", "left")
    return out.select(
        "method_id",
        F.col("span.begin").alias("exceptionLinesBegin"),
        F.col("span.end").alias("exceptionLinesEnd"),
        F.coalesce(F.col("_type"), F.lit("Exception")).alias("exceptionType"),
        F.lit(0).alias("errorCode"),
        F.col("code").alias("code_data"),
        comma_list(F.col("preds")).alias("line_predict"))


def feedback_records(replies: DataFrame) -> DataFrame:
    """S11 rows for replies: evaluation starts at -1, human columns empty."""
    return replies.select(
        F.col("method_id").alias("record_id"), "code_data", "line_predict",
        F.col("exceptionType").alias("exception_predict"),
        F.lit(-1).alias("user_evaluation"), F.lit("").alias("line_artificial"),
        F.lit("").alias("exception_artificial"))
