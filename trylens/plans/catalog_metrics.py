"""Registered queries: metrics and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as G
from ..operators import ranking as K
from ..operators.structure import merge_statement_lines, tag_lines
from ..operators.util import with_position
from ..sources import fixtures as fx
from .catalog_structure import _D_GRP, _D_TAGGED
from .oracle import with_fixtures
from .registry import query


def _r(c, d=6):
    return F.round(F.col(c) if isinstance(c, str) else c, d)


def _rounded(df, *cols):
    return df.select(*[(_r(c).alias(c) if c in cols else F.col(c)) for c in df.columns])


# Validation predictions: argmax of the class scores vs the label; five epochs.
_D_PRED = ("d_pred", "SELECT id, CAST(id % 5 AS INTEGER) AS epoch, any_value(label) AS label, "
                     "arg_max(class_id, struct_pack(l := logit, c := -class_id)) AS pred FROM logits GROUP BY id")


def predictions(spark, sf_dir):
    """(id, pred, label, epoch): argmax and label in one aggregation per row id."""
    lg = fx.logits(spark, sf_dir)
    best = lg.groupBy("id").agg(
        F.max_by("class_id", F.struct(F.col("logit"), -F.col("class_id"))).alias("pred"),
        F.first("label").alias("label"))
    return best.withColumn("epoch", (F.col("id") % 5).cast("int"))


@query("classification_accuracy", with_fixtures(
    "SELECT round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM d_pred",
    "logits", ctes=(_D_PRED,)))
def classification_accuracy(spark, sf_dir):
    return _rounded(G.classification_accuracy(predictions(spark, sf_dir)), "accuracy")


def _prf_ctes(g: str) -> tuple[tuple[str, str], ...]:
    return (
        ("cells", f"SELECT {g} label, pred, count(*) AS n FROM d_pred GROUP BY ALL"),
        ("pc", f"""SELECT {g} cls, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM (
  SELECT {g} label AS cls, n AS support, CASE WHEN label = pred THEN n ELSE 0 END AS tp, 0 AS predicted FROM cells
  UNION ALL SELECT {g} pred, 0, 0, n FROM cells) GROUP BY ALL"""))


_PRF_COLS = """round(sum(CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 1.0 END * support) / sum(support), 6) AS precision,
 round(sum(CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 1.0 END * support) / sum(support), 6) AS recall,
 round(sum(CAST(2 * tp AS DOUBLE) / (support + predicted) * support) / sum(support), 6) AS f1"""


@query("weighted_precision_recall_f1", with_fixtures(
    f"SELECT {_PRF_COLS} FROM pc", "logits", ctes=(_D_PRED,) + _prf_ctes("")))
def weighted_precision_recall_f1(spark, sf_dir):
    return _rounded(G.weighted_precision_recall_f1(predictions(spark, sf_dir)), "precision", "recall", "f1")


@query("epoch_validation_report", with_fixtures(
    f"""SELECT pc.epoch, any_value(a.accuracy) AS accuracy, {_PRF_COLS} FROM pc JOIN (
 SELECT epoch, round(avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM d_pred GROUP BY epoch) a
 ON a.epoch = pc.epoch GROUP BY pc.epoch""",
    "logits", ctes=(_D_PRED,) + _prf_ctes("epoch,")))
def epoch_validation_report(spark, sf_dir):
    r = G.epoch_validation_report(predictions(spark, sf_dir))
    return _rounded(r, "accuracy", "precision", "recall", "f1")


_LINES50 = ("d_l50", "SELECT * FROM code_lines WHERE line_no <= 50")


@query("line_precision_recall_f1", with_fixtures(
    """SELECT round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
 round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
 round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1
 FROM (SELECT CAST(count(*) FILTER (WHERE label = 1 AND pred = 1) AS DOUBLE) AS tp,
  count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn FROM d_l50)""",
    "code_lines", ctes=(_LINES50,)))
def line_precision_recall_f1(spark, sf_dir):
    cl = fx.code_lines(spark, sf_dir).where(F.col("line_no") <= 50)
    return _rounded(G.line_precision_recall_f1(cl), "precision", "recall", "f1")


_STATS = ("d_stats", """SELECT method_id, count(*) FILTER (WHERE label = pred) AS correct, count(*) AS n_real,
 count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label = 1) AS positives,
 bool_and(label = pred) AS match_all FROM d_l50 GROUP BY method_id""")


def _stats(spark, sf_dir):
    return G.per_method_line_stats(fx.code_lines(spark, sf_dir))


@query("mean_method_line_accuracy", with_fixtures(
    "SELECT round(avg((correct + 50 - n_real) / 50.0), 6) AS mean_line_accuracy FROM d_stats",
    "code_lines", ctes=(_LINES50, _STATS)))
def mean_method_line_accuracy(spark, sf_dir):
    return _rounded(G.mean_method_line_accuracy(_stats(spark, sf_dir)), "mean_line_accuracy")


@query("mean_method_line_recall", with_fixtures(
    "SELECT round(avg(CASE WHEN positives > 0 THEN tp / positives ELSE 1.0 END), 6) AS mean_line_recall FROM d_stats",
    "code_lines", ctes=(_LINES50, _STATS)))
def mean_method_line_recall(spark, sf_dir):
    return _rounded(G.mean_method_line_recall(_stats(spark, sf_dir)), "mean_line_recall")


# Merged labels (A2) by position; positions past the merged lines are padding
# with label 0, where the model may still predict 1.
_D_MERGED = ("d_merged", """SELECT method_id, grp, arg_min(label, line_no) AS label FROM d_grp WHERE grp > 0
 GROUP BY method_id, grp""")
_D_POS = ("d_pos", """SELECT c.method_id, c.line_no, c.pred, coalesce(m.label, 0) AS label, n.lines_count FROM code_lines c
 JOIN (SELECT method_id, max(grp) AS lines_count FROM d_grp GROUP BY method_id) n ON n.method_id = c.method_id
 LEFT JOIN d_merged m ON m.method_id = c.method_id AND m.grp = c.line_no WHERE c.line_no <= 50""")


def _exact_sql(cond: str) -> str:
    return with_fixtures(
        "SELECT round(avg(CASE WHEN bad = 0 THEN 1.0 ELSE 0.0 END), 6) AS rate, "
        "CAST(count(*) FILTER (WHERE bad = 0) AS BIGINT) AS hits, count(*) AS total FROM "
        f"(SELECT method_id, count(*) FILTER (WHERE label <> pred AND {cond}) AS bad FROM d_pos GROUP BY method_id)",
        "code_lines", ctes=(_D_TAGGED, _D_GRP, _D_MERGED, _D_POS))


def _merged_stats(spark, sf_dir):
    m = fx.methods(spark, sf_dir)
    merged = merge_statement_lines(F.col("lines"), F.col("labels"), tag_lines(F.col("lines")))
    x = m.select("method_id", "preds", merged.alias("m"))
    z = F.arrays_zip(F.transform("m", lambda g: g["label"]).alias("l"), F.col("preds").alias("p"))
    x = x.select("method_id", F.size("m").alias("lines_count"), F.posexplode(z).alias("i", "z"))
    lines = x.select("method_id", "lines_count", (F.col("i") + 1).alias("line_no"),
                     F.coalesce("z.l", F.lit(0)).alias("label"), F.col("z.p").alias("pred"))
    return G.per_method_line_stats(lines, lines_count="lines_count")


@query("exact_match_rate", _exact_sql("line_no <= lines_count"))
def exact_match_rate(spark, sf_dir):
    return _rounded(G.exact_match_rate(_merged_stats(spark, sf_dir), "match_within"), "rate")


@query("exact_match_rate_padded", _exact_sql("true"))
def exact_match_rate_padded(spark, sf_dir):
    return _rounded(G.exact_match_rate(_merged_stats(spark, sf_dir), "match_all"), "rate")


_RANK_SQL = ("d_rank", """SELECT a.id, 1 + count(*) FILTER (WHERE greatest(b.logit, 0) > greatest(a.logit, 0)
   OR (greatest(b.logit, 0) = greatest(a.logit, 0) AND b.class_id < a.class_id)) AS true_rank
 FROM logits a JOIN logits b ON a.id = b.id WHERE a.class_id = a.label GROUP BY a.id""")


@query("topn_accuracy", with_fixtures(
    "SELECT " + ", ".join(f"round(avg(CASE WHEN true_rank <= {n} THEN 1.0 ELSE 0.0 END), 6) AS top{n}"
                          for n in (1, 2, 3, 5, 10)) + " FROM d_rank", "logits", ctes=(_RANK_SQL,)))
def topn_accuracy(spark, sf_dir):
    ranks = K.true_class_rank(fx.logits(spark, sf_dir))
    r = G.topn_accuracy(ranks)
    return _rounded(r, *r.columns)


@query("mean_cross_entropy", with_fixtures(
    """SELECT round(sum(bs) / sum(bn), 6) AS mean_ce, round(sum(bm) / sum(bn), 6) AS ref_ce FROM (
 SELECT batch, avg(ce) AS bm, sum(ce) AS bs, count(*) AS bn FROM (
  SELECT (row_number() OVER (ORDER BY id) - 1) // 32 AS batch, ce FROM (
   SELECT id, ln(sum(exp(logit - m))) + m - max(CASE WHEN class_id = label THEN logit END) AS ce
   FROM (SELECT *, max(logit) OVER (PARTITION BY id) AS m FROM logits) GROUP BY id, m)) GROUP BY batch)""",
    "logits"))
def mean_cross_entropy(spark, sf_dir):
    ce = G.cross_entropy(fx.logits(spark, sf_dir))
    batched = K.assign_batches(ce, [F.col("id")], 32)
    return _rounded(G.mean_cross_entropy(batched), "mean_ce", "ref_ce")


@query("training_window_rollup", with_fixtures(
    """SELECT epoch, win, round(sl / 100, 6) AS avg_loss, round(100.0 * sc / st, 6) AS accuracy_pct FROM (
 SELECT epoch, CAST(floor(batch / 100) AS INTEGER) AS win, sum(loss) AS sl, sum(correct) AS sc, sum(total) AS st,
  count(*) AS n FROM train_log GROUP BY ALL) WHERE n = 100""", "train_log"))
def training_window_rollup(spark, sf_dir):
    return _rounded(G.training_window_rollup(fx.train_log(spark, sf_dir)), "avg_loss", "accuracy_pct")


@query("softmax_scores", with_fixtures(
    "SELECT id, class_id, round(e / sum(e) OVER (PARTITION BY id), 6) AS prob FROM "
    "(SELECT id, class_id, exp(logit - max(logit) OVER (PARTITION BY id)) AS e FROM logits)", "logits"))
def softmax_scores(spark, sf_dir):
    s = K.softmax_scores(fx.logits(spark, sf_dir))
    return s.select("id", "class_id", _r("prob").alias("prob"))


@query("topk_classes", with_fixtures(
    """SELECT id, "rank", class_id, round(prob, 6) AS prob FROM (
 SELECT id, class_id, e / sum(e) OVER (PARTITION BY id) AS prob,
  CAST(row_number() OVER (PARTITION BY id ORDER BY s DESC, class_id) AS INTEGER) AS "rank" FROM (
  SELECT id, class_id, greatest(logit, 0) AS s, exp(greatest(logit, 0) - max(greatest(logit, 0)) OVER (PARTITION BY id)) AS e
  FROM logits)) WHERE "rank" <= 3""", "logits"))
def topk_classes(spark, sf_dir):
    t = K.topk_classes(fx.logits(spark, sf_dir), 3)
    return t.select("id", "rank", "class_id", _r("prob").alias("prob"))


@query("argmax_class", with_fixtures(
    "SELECT id, arg_max(class_id, struct_pack(l := logit, c := -class_id)) AS class_id FROM logits GROUP BY id",
    "logits"))
def argmax_class(spark, sf_dir):
    return K.argmax_class(fx.logits(spark, sf_dir))


@query("seeded_shuffle", """SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42:0'), o_orderkey) - 1 AS pos FROM orders""")
def seeded_shuffle(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey")
    return K.seeded_shuffle(o, "o_orderkey", seed=42, epoch=0)


@query("assign_batches", """SELECT o_orderkey, (rn // 4) AS batch_4, (rn // 16) AS batch_16, (rn // 32) AS batch_32
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders)""")
def assign_batches(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey")
    p = with_position(o, [F.col("o_orderkey")], "rn")
    return p.select("o_orderkey", *[F.floor(F.col("rn") / n).cast("long").alias(f"batch_{n}") for n in (4, 16, 32)])


@query("mean_pool_vectors", """SELECT label, CAST(d - 1 AS INTEGER) AS dim, round(avg(CAST(embedding[d] AS DOUBLE)), 6) AS value
FROM embeddings, range(1, 65) r(d) WHERE d <= len(embedding) GROUP BY label, d""")
def mean_pool_vectors(spark, sf_dir):
    from ..operators.vectors import mean_pool_vectors as pool
    e = fx.table(spark, sf_dir, "embeddings")
    return pool(e, "label", "embedding").select("label", "dim", _r("value").alias("value"))


@query("concat_feature_vectors", """SELECT a.vec_id, CAST(d - 1 AS INTEGER) AS dim,
 round(CAST((list_concat(a.embedding, b.embedding))[d] AS DOUBLE), 6) AS value
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, range(1, 129) r(d)
WHERE d <= len(a.embedding) + len(b.embedding)""")
def concat_feature_vectors(spark, sf_dir):
    from ..operators.vectors import concat_feature_vectors as cat
    e = fx.table(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next_embedding"))
    v = cat(e.select("vec_id", "embedding").join(nxt, "vec_id"), "embedding", "next_embedding")
    x = v.select("vec_id", F.posexplode("features").alias("dim", "value"))
    return x.select("vec_id", "dim", _r(F.col("value").cast("double")).alias("value"))
