"""Registered queries: count-based models (L1-L4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.streams import read_front_back
from ..operators import labels as L
from ..operators import models as M
from ..operators.util import materialize
from ..sources import fixtures as fx
from . import flows
from . import oracle_exprs as X
from .catalog_clean import _rename_sql
from .catalog_encode import _T2_MARK
from .catalog_labels import P7_SQL
from .catalog_structure import _D_TAGGED
from .oracle import with_fixtures
from .registry import query

_DOCS = ("d_docs", f"""SELECT d.method_id, m.split, CAST(coalesce(c.class_id, 0) AS INTEGER) AS label,
 list_concat(list_transform(d.front, lambda t: 'f:' || t), list_transform(d.back, lambda t: 'b:' || t)) AS toks
 FROM d_t2 d JOIN methods m ON m.method_id = d.method_id
 LEFT JOIN class_map c ON c.name = ({P7_SQL.replace('tgt', 'm.tgt')})""")


def _nb_model_ctes(docs: str, label: str, split_filter: str, p: str = "d_") -> tuple[tuple[str, str], ...]:
    return (
        (f"{p}cnt", f"SELECT {label} AS class_id, tk AS token, count(*) AS n FROM (SELECT {label}, unnest(toks) AS tk "
                    f"FROM {docs} WHERE {split_filter}) GROUP BY ALL"),
        (f"{p}v", f"SELECT count(DISTINCT token) AS v FROM {p}cnt"),
        (f"{p}cls", f"SELECT c.class_id, c.n_c, d.d_c FROM (SELECT class_id, sum(n) AS n_c FROM {p}cnt GROUP BY class_id) c "
                    f"JOIN (SELECT {label} AS class_id, count(*) AS d_c FROM {docs} WHERE {split_filter} GROUP BY ALL) d "
                    "ON c.class_id = d.class_id"),
        (f"{p}model", "SELECT c.class_id, c.token, ln((c.n + 1.0) / (k.n_c + v.v)) AS log_lik, "
                      f"ln(k.d_c / (SELECT sum(d_c) FROM {p}cls)) AS prior, ln(1.0 / (k.n_c + v.v)) AS unseen "
                      f"FROM {p}cnt c JOIN {p}cls k ON k.class_id = c.class_id, {p}v v"),
    )


def _nb_score_ctes(docs: str, key: str, split_filter: str, p: str = "d_") -> tuple[tuple[str, str], ...]:
    return (
        (f"{p}tf", f"SELECT {key}, token, count(*) AS tf FROM (SELECT {key}, unnest(toks) AS token FROM {docs} "
                   f"WHERE {split_filter}) GROUP BY ALL"),
        (f"{p}known", f"SELECT {key}, sum(tf) AS n_known FROM {p}tf WHERE token IN (SELECT token FROM {p}model) GROUP BY ALL"),
        (f"{p}seen", f"SELECT t.{key}, m.class_id, sum((m.log_lik - m.unseen) * t.tf) AS s FROM {p}tf t "
                     f"JOIN {p}model m ON m.token = t.token GROUP BY ALL"),
        (f"{p}score", f"""SELECT d.{key}, c.class_id, round(c.prior + coalesce(k.n_known, 0) * c.unseen + coalesce(s.s, 0), 6) AS score
 FROM (SELECT {key} FROM {docs} WHERE {split_filter}) d CROSS JOIN (SELECT DISTINCT class_id, prior, unseen FROM {p}model) c
 LEFT JOIN {p}known k ON k.{key} = d.{key} LEFT JOIN {p}seen s ON s.{key} = d.{key} AND s.class_id = c.class_id"""),
        (f"{p}best", f"SELECT {key}, arg_max(class_id, struct_pack(s := score, c := -class_id)) AS class_id "
                     f"FROM {p}score GROUP BY {key}"),
    )


def type_docs(spark, sf_dir):
    c = flows.task2_corpus(fx.methods(spark, sf_dir), fx.class_map(spark))
    return c.select("method_id", "split", "label",
                    M.prefixed_tokens(("f:", F.col("front")), ("b:", F.col("back"))).alias("tokens"))


def type_texts(spark, sf_dir, split):
    """The rows of one split that ``read_front_back`` makes the tokens of ``type_docs`` from."""
    return flows.task2_texts(_split(spark, sf_dir, split), fx.class_map(spark))


def exception_model(spark, sf_dir):
    return M.fit_naive_bayes(type_texts(spark, sf_dir, "train"), tokens=("src", "tgt"), read=read_front_back)


def _r6(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("fit_exception_classifier", with_fixtures(
    "SELECT class_id, token, round(log_lik, 6) AS log_lik, round(prior, 6) AS prior, round(unseen, 6) AS unseen FROM d_model",
    "methods", "class_map", ctes=(_T2_MARK, _DOCS) + _nb_model_ctes("d_docs", "label", "split = 'train'")))
def fit_exception_classifier(spark, sf_dir):
    return _r6(exception_model(spark, sf_dir), "log_lik", "prior", "unseen")


@query("score_exception_type", with_fixtures(
    "SELECT b.method_id, b.class_id, m.name AS exception FROM d_best b JOIN class_map m ON m.class_id = b.class_id",
    "methods", "class_map", ctes=(_T2_MARK, _DOCS) + _nb_model_ctes("d_docs", "label", "split = 'train'")
    + _nb_score_ctes("d_docs", "method_id", "split = 'test'")))
def score_exception_type(spark, sf_dir):
    model = materialize(exception_model(spark, sf_dir))
    best = M.class_scores(type_texts(spark, sf_dir, "test"), model, "method_id", ("src", "tgt"), read_front_back) \
            .select("method_id", "class_id")
    return L.decode_class(best, fx.class_map(spark)).select("method_id", "class_id", "exception")


_FUNC_SQL = f"({X.clean_src('src')} || tgt || chr(10) || ' }}')"

_LINE_DOCS = ("d_ldocs", f"""SELECT struct_pack(m := method_id, l := line_no) AS line_key, method_id, line_no, split, label,
 list_concat(t, list_transform(coalesce(lag(t) OVER w, []), lambda x: 'p:' || x),
  list_transform(coalesce(lead(t) OVER w, []), lambda x: 'n:' || x)) AS toks
 FROM (SELECT *, {X.split_ws(_rename_sql('mline'))} AS t
  FROM (SELECT *, {X.strip("line || coalesce(tag, '')")} AS mline FROM d_tagged)) WINDOW w AS (PARTITION BY method_id ORDER BY line_no)""")


def _split(spark, sf_dir, split):
    return fx.methods(spark, sf_dir).where(F.col("split") == split)


@query("fit_line_classifier", with_fixtures(
    "SELECT class_id, token, round(log_lik, 6) AS log_lik, round(prior, 6) AS prior, round(unseen, 6) AS unseen FROM d_model",
    "code_lines", ctes=(_D_TAGGED, _LINE_DOCS) + _nb_model_ctes("d_ldocs", "label", "split = 'train'")))
def fit_line_classifier(spark, sf_dir):
    return _r6(flows.fit_line_model(_split(spark, sf_dir, "train")), "log_lik", "prior", "unseen")


@query("score_lines", with_fixtures(
    "SELECT d.method_id, d.line_no, CAST(b.class_id AS INTEGER) AS pred FROM d_best b JOIN d_ldocs d ON d.line_key = b.line_key",
    "code_lines", ctes=(_D_TAGGED, _LINE_DOCS) + _nb_model_ctes("d_ldocs", "label", "split = 'train'")
    + _nb_score_ctes("d_ldocs", "line_key", "split = 'test'")))
def score_lines(spark, sf_dir):
    model = materialize(flows.fit_line_model(_split(spark, sf_dir, "train")))
    best = flows.score_lines(_split(spark, sf_dir, "test"), model)
    return best.select("method_id", "line_no", F.col("class_id").cast("int").alias("pred"))


# --- L3/L4 with a chain over the lines ---------------------------------------

_OWN_DOCS = ("d_own", f"""SELECT struct_pack(m := method_id, l := line_no) AS line_key, method_id, line_no, split, label,
 {X.split_ws(_rename_sql('mline'))} AS toks FROM (SELECT *, {X.strip("line || coalesce(tag, '')")} AS mline FROM d_tagged)""")
# Log weights of the chain and, per line, what the words alone say of class 0 and 1.
_CHAIN = (
    ("d_tr", """SELECT prev, next, count(*) AS n FROM (SELECT label AS next, lag(label) OVER (PARTITION BY method_id ORDER BY line_no) AS prev
 FROM d_own WHERE split = 'train') GROUP BY ALL"""),
    ("d_w", """SELECT p.prev, c.next, round(ln((coalesce(n, 0) + 1.0) / (sum(coalesce(n, 0)) OVER (PARTITION BY p.prev) + 2.0)), 6) AS w
 FROM (VALUES (NULL), (0), (1)) p(prev) CROSS JOIN (VALUES (0), (1)) c(next) LEFT JOIN d_tr t ON t.prev IS NOT DISTINCT FROM p.prev AND t.next = c.next"""),
    ("d_ww", """SELECT max(w) FILTER (prev IS NULL AND next = 0) AS i0, max(w) FILTER (prev IS NULL AND next = 1) AS i1,
 max(w) FILTER (prev = 0 AND next = 0) AS t00, max(w) FILTER (prev = 0 AND next = 1) AS t01,
 max(w) FILTER (prev = 1 AND next = 0) AS t10, max(w) FILTER (prev = 1 AND next = 1) AS t11 FROM d_w"""),
    ("d_em", """SELECT line_key.m AS method_id, line_key.l AS line_no, max(e) FILTER (class_id = 0) AS e0, max(e) FILTER (class_id = 1) AS e1
 FROM (SELECT s.line_key, s.class_id, round(s.score - p.prior, 6) AS e FROM d_score s
       JOIN (SELECT DISTINCT class_id, prior FROM d_model) p ON p.class_id = s.class_id) GROUP BY ALL"""),
    ("d_fwd", """SELECT method_id, line_no, e0 + i0 AS s0, e1 + i1 AS s1, 0 AS b0, 0 AS b1 FROM d_em, d_ww WHERE line_no = 1
 UNION ALL
 SELECT e.method_id, e.line_no, greatest(f.s0 + t00, f.s1 + t10) + e0, greatest(f.s0 + t01, f.s1 + t11) + e1,
  CASE WHEN f.s1 + t10 > f.s0 + t00 THEN 1 ELSE 0 END, CASE WHEN f.s1 + t11 > f.s0 + t01 THEN 1 ELSE 0 END
 FROM d_fwd f JOIN d_em e ON e.method_id = f.method_id AND e.line_no = f.line_no + 1, d_ww"""),
    ("d_path", """SELECT method_id, line_no, CASE WHEN s1 > s0 THEN 1 ELSE 0 END AS pred,
  CASE WHEN s1 > s0 THEN b1 ELSE b0 END AS came FROM (SELECT *, max(line_no) OVER (PARTITION BY method_id) AS n FROM d_fwd) WHERE line_no = n
 UNION ALL
 SELECT f.method_id, f.line_no, p.came, CASE WHEN p.came = 1 THEN f.b1 ELSE f.b0 END
 FROM d_path p JOIN d_fwd f ON f.method_id = p.method_id AND f.line_no = p.line_no - 1"""),
)
_CHAIN_CTES = (_D_TAGGED, _OWN_DOCS, *_nb_model_ctes("d_own", "label", "split = 'train'"),
               *_nb_score_ctes("d_own", "line_key", "split = 'test'"), *_CHAIN)


def _recursive(body: str, ctes) -> str:
    return "WITH RECURSIVE" + with_fixtures(body, "code_lines", ctes=ctes)[len("WITH"):]


def _line_sequences(spark, sf_dir):
    """(method_id, line_no, label, pred): test lines labelled by the chain."""
    from ..operators import chain
    from ..operators.structure import read_line_words
    methods = materialize(fx.methods(spark, sf_dir).select("method_id", "split", "lines", "labels"), "methods")
    train, test = (methods.where(F.col("split") == x) for x in ("train", "test"))
    model = materialize(M.fit_naive_bayes(train, "labels", "lines", read=read_line_words))
    # the chain has its own view of how frequent a label is: the prior is taken out
    priors = {r["class_id"]: r["prior"] for r in model.select("class_id", "prior").distinct().limit(chain.MAX_CLASSES + 1).collect()}
    known = F.create_map(*[F.lit(x) for c, p in priors.items() for x in (c, p)])
    scored = M.class_scores(test, model, "method_id", "lines", read_line_words, "line_no").select("method_id", "line_no", F.transform(
        "scores", lambda s: F.struct(s["class_id"].alias("class_id"), F.round(s["score"] - F.element_at(known, s["class_id"]), 6).alias("score"))).alias("scores"))
    out = chain.score_sequences(materialize(scored, "line_scores"), chain.fit_transitions(train))
    labels = test.select("method_id", F.posexplode(F.arrays_zip("lines", "labels")).alias("i", "z"))
    labels = labels.select("method_id", (F.col("i") + 1).cast("int").alias("line_no"), F.col("z.labels").alias("label"))
    return out.join(labels, ["method_id", "line_no"]).select("method_id", "line_no", "label", F.col("class_id").cast("int").alias("pred"))


@query("score_line_sequences", _recursive(
    "SELECT p.method_id, p.line_no, o.label, CAST(p.pred AS INTEGER) AS pred FROM d_path p "
    "JOIN d_own o ON o.method_id = p.method_id AND o.line_no = p.line_no", _CHAIN_CTES))
def score_line_sequences(spark, sf_dir):
    return _line_sequences(spark, sf_dir)


@query("line_sequence_metrics", _recursive(
    """SELECT tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM (
 SELECT CAST(count(*) FILTER (label = 1 AND pred = 1) AS DOUBLE) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp,
  count(*) FILTER (label = 1 AND pred = 0) AS fn FROM d_path p JOIN d_own o ON o.method_id = p.method_id AND o.line_no = p.line_no)""",
    _CHAIN_CTES))
def line_sequence_metrics(spark, sf_dir):
    """G6 of the chain's labels."""
    from ..operators import metrics
    return metrics.line_precision_recall_f1(_line_sequences(spark, sf_dir))


def handler_inputs(spark, sf_dir):
    """Fitted line and type models plus the test-split submissions."""
    methods = materialize(fx.methods(spark, sf_dir))
    line_model, type_model = flows.fit_handler_models(methods, fx.class_map(spark))
    subs = methods.where(F.col("split") == "test").select("method_id", F.array_join("lines", "\n").alias("code"))
    return subs, line_model, type_model


def _ast_tokens_sql(func: str) -> str:
    """A5 + A4 in DuckDB over ``func`` (depth computed inline)."""
    from .catalog_structure import _depth_sql
    d = _depth_sql(X.split_ws(func))
    p1 = f"replace(replace(regexp_replace({func}, '{X.WS}*([().]){X.WS}*', '\\1', 'g'), chr(13), ' '), chr(9), ' ')"
    repaired = func + " || repeat(' }', " + d + ")"
    fallback = p1 + " || ' } } }'"
    return (f"(CASE WHEN {d} BETWEEN 0 AND 2 THEN {X.structural_stream(repaired)} "
            f"ELSE {X.split_ws(fallback)} END)")


def _fb_docs(tokens: str) -> str:
    ti, ci = X.last_marker(tokens, "TRY"), X.last_marker(tokens, "CatchClause")
    front, back = X.py_slice(tokens, None, ti), X.py_slice(tokens, ti, ci)
    return (f"list_concat(list_transform({front}, lambda t: 'f:' || t), "
            f"list_transform({back}, lambda t: 'b:' || t))")


_L5_CTES = (
    _D_TAGGED,
    _LINE_DOCS,
    *_nb_model_ctes("d_ldocs", "label", "split = 'train'", "l_"),
    *_nb_score_ctes("d_ldocs", "line_key", "split = 'test'", "l_"),
    ("l5_preds", """SELECT d.method_id, list_slice(list_concat(list(CAST(b.class_id AS INTEGER) ORDER BY d.line_no),
  list_transform(range(50), lambda z: 0)), 1, greatest(50, count(*))) AS preds FROM l_best b JOIN d_ldocs d ON d.line_key = b.line_key
 GROUP BY d.method_id"""),
    ("l5_span", """SELECT p.method_id, m.lines, p.preds, b AS bg,
 CASE WHEN b > 0 AND coalesce(list_position(list_slice(p.preds, b + 2, len(p.preds)), 0), 0) > 0
      THEN b + list_position(list_slice(p.preds, b + 2, len(p.preds)), 0) - 1 ELSE len(p.preds) END AS en
 FROM (SELECT method_id, preds, coalesce(list_position(preds, 1), 0) - 1 AS b FROM l5_preds) p
 JOIN methods m ON m.method_id = p.method_id"""),
    ("l5_try", """SELECT method_id, preds, bg, en, """
     + X.clean_src(
         f"array_to_string({X.py_slice('lines', '0', 'bg')}, chr(10)) || chr(10) || 'try {{' || chr(10) || "
         f"array_to_string({X.py_slice('lines', 'bg', 'en + 1')}, chr(10)) || chr(10) || "
         f"'}} catch ( Exception e ) {{ }} ' || chr(10) || array_to_string({X.py_slice('lines', 'en + 1', None)}, chr(10))")
     + " AS func FROM l5_span"),
    ("l5_tok", f"SELECT method_id, preds, bg, en, {_ast_tokens_sql('func')} AS ast FROM l5_try"),
    ("l5_tdocs", f"SELECT method_id, 'test' AS split, {_fb_docs('ast')} AS toks FROM l5_tok"),
    ("t_train", f"""SELECT m.method_id, m.split, CAST(coalesce(c.class_id, 0) AS INTEGER) AS label,
 {_fb_docs('ast')} AS toks FROM (SELECT method_id, split, tgt, {_ast_tokens_sql(_FUNC_SQL)} AS ast FROM methods) m
 LEFT JOIN class_map c ON c.name = ({P7_SQL.replace('tgt', 'm.tgt')})"""),
    *_nb_model_ctes("t_train", "label", "split = 'train'", "t_"),
    *_nb_score_ctes("l5_tdocs", "method_id", "split = 'test'", "t_"),
)


@query("predict_handlers", with_fixtures(
    """SELECT k.method_id, CAST(k.bg AS INTEGER) AS exceptionLinesBegin, CAST(k.en AS INTEGER) AS exceptionLinesEnd,
 coalesce(c.name, 'Exception') AS exceptionType, 0 AS errorCode, array_to_string(k.preds, ',') AS line_predict
 FROM l5_tok k LEFT JOIN t_best b ON b.method_id = k.method_id LEFT JOIN class_map c ON c.class_id = b.class_id""",
    "methods", "class_map", ctes=_L5_CTES))
def predict_handlers(spark, sf_dir):
    subs, line_model, type_model = handler_inputs(spark, sf_dir)
    replies = flows.predict_handlers(subs, line_model, type_model, fx.class_map(spark))
    return replies.select("method_id", "exceptionLinesBegin", "exceptionLinesEnd", "exceptionType",
                          "errorCode", "line_predict")


_FEEDBACK_SQL = with_fixtures(
    """SELECT k.method_id AS record_id, array_to_string(m.lines, chr(10)) AS code_data, array_to_string(k.preds, ',') AS line_predict,
 coalesce(c.name, 'Exception') AS exception_predict, -1 AS user_evaluation, '' AS line_artificial, '' AS exception_artificial
 FROM l5_tok k JOIN methods m ON m.method_id = k.method_id LEFT JOIN t_best b ON b.method_id = k.method_id
 LEFT JOIN class_map c ON c.class_id = b.class_id""", "methods", "class_map", ctes=_L5_CTES)


@query("record_reply_feedback", _FEEDBACK_SQL)
def record_reply_feedback(spark, sf_dir):
    """S11 fed by L5: one feedback row per reply, appended and read back."""
    from ..sources import tables
    subs, line_model, type_model = handler_inputs(spark, sf_dir)
    replies = flows.predict_handlers(subs, line_model, type_model, fx.class_map(spark))
    path = tables.shared_path(spark, "reply-feedback")
    tables.append_feedback(flows.feedback_records(replies), path)
    return tables.read_feedback(spark, path)


@query("write_ast_corpus", with_fixtures(
    f"""SELECT a.method_id, a.split, {X.join_sp(X.py_slice('ast', None, X.last_marker('ast', 'TRY')))} AS front,
 {X.join_sp(X.py_slice('ast', X.last_marker('ast', 'TRY'), X.last_marker('ast', 'CatchClause')))} AS back,
 array_to_string({X.split_ws(X.clean_src('src'))}, ' ') AS source, a.tgt, CAST(coalesce(c.class_id, 0) AS INTEGER) AS label
 FROM (SELECT method_id, split, src, tgt, {_ast_tokens_sql(_FUNC_SQL)} AS ast FROM methods) a
 LEFT JOIN class_map c ON c.name = ({P7_SQL.replace('tgt', 'a.tgt')})""", "methods", "class_map"))
def write_ast_corpus(spark, sf_dir):
    """S8 on the marker stream: P2 + P4 + A5/A4, the TRY/CatchClause split, the
    source tokens, the target and its label."""
    from ..sources import tables
    out = flows.ast_corpus(fx.methods(spark, sf_dir), fx.class_map(spark))
    return tables.write_and_read(spark, out, "ast_corpus", partition_by=("split",))


def _l6_sql() -> str:
    from .catalog_encode import _T2_MARK, _T2_VOCAB, _framed, _t2_ids
    body = f"""SELECT method_id, CAST(arg_max(c, struct_pack(s := s, nc := -c)) AS INTEGER) AS class_id FROM (
 SELECT method_id, c, sum(CASE WHEN id % 4096 = 0 THEN 0 ELSE ((id % 4096) * 7919 + c * 104729) % 101 - 50 END) AS s
 FROM (SELECT f.method_id, unnest(list_concat({_framed('f.ids', 256)}, {_framed('b.ids', 256)})) AS id
       FROM d_t2front f JOIN d_t2back b USING (method_id)), range(10) r(c)
 GROUP BY method_id, c) GROUP BY method_id"""
    return with_fixtures(body, "methods", ctes=(_T2_MARK, _T2_VOCAB, _t2_ids("front"), _t2_ids("back")))


@query("score_with_external_model", _l6_sql())
def score_with_external_model(spark, sf_dir):
    from ..operators import encode as E
    from ..operators.external import hashed_linear_model, score_with_external_model as score
    corpus = materialize(flows.task2_corpus(fx.methods(spark, sf_dir), fx.class_map(spark)))
    vocab = materialize(E.build_vocabulary(corpus.select(F.explode(F.concat("front", "back")).alias("token"))))
    ids = E.encode_text(corpus, ["method_id"], ["front", "back"], vocab, flows.TEXT_MAX).select("method_id", F.concat("front_input_ids", "back_input_ids").alias("ids"))
    out = score(ids, "ids", 2 * flows.TEXT_MAX, hashed_linear_model())
    return out.select("method_id", "class_id")


def _mllib_predictions(spark, sf_dir):
    """Test methods scored once by the MLlib baseline and written."""
    from pyspark.ml.functions import vector_to_array
    from ..operators.external import fit_mllib_baseline as fit
    docs = materialize(type_docs(spark, sf_dir))
    model = fit(docs.where(F.col("split") == "train"))
    return materialize(model.transform(docs.where(F.col("split") == "test")).select(
        "method_id", "label", F.col("prediction").cast("int").alias("pred"),
        vector_to_array("probability").alias("p")))


def _as_rows(row, key: str):
    """A one-row table as (key, value) rows."""
    pairs = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in row.columns)
    return row.selectExpr(f"stack({len(row.columns)}, {pairs}) AS ({key}, value)")


def _mllib_metrics(pred):
    from ..operators import metrics as G
    from ..operators import ranking as K
    long = pred.select(F.col("method_id").alias("id"), "label", F.posexplode("p").alias("class_id", "logit"))
    parts = (G.classification_accuracy(pred), G.weighted_precision_recall_f1(pred), G.topn_accuracy(K.true_class_rank(long)))
    acc, prf, top = (_as_rows(d, "metric") for d in parts)
    return acc.unionByName(prf).unionByName(top)


@query("fit_mllib_baseline")
def fit_mllib_baseline(spark, sf_dir):
    return _mllib_metrics(_mllib_predictions(spark, sf_dir))


@query("mllib_baseline_facts", with_fixtures(
    """SELECT 'scored' AS fact, CAST(count(*) AS DOUBLE) AS value FROM d_docs WHERE split = 'test'
 UNION ALL SELECT 'methods', CAST(count(DISTINCT method_id) AS DOUBLE) FROM d_docs WHERE split = 'test'
 UNION ALL SELECT 'classes', CAST(max(label) + 1 AS DOUBLE) FROM d_docs WHERE split = 'train'
 UNION ALL SELECT unnest(['distributions', 'best_class', 'rates_in_bounds', 'topn_monotone']), CAST(1 AS DOUBLE)""",
    "methods", "class_map", ctes=(_T2_MARK, _DOCS)))
def mllib_baseline_facts(spark, sf_dir):
    """What is exact about L7 whatever the optimiser finds: rows scored, class
    count, probabilities that sum to one, the prediction as their argmax, rates
    within 0 and 1, top-n growing with n."""
    pred = _mllib_predictions(spark, sf_dir)
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x)
    rows = pred.agg(
        F.count("*").alias("scored"), F.countDistinct("method_id").alias("methods"), F.max(F.size("p")).alias("classes"),
        F.min((F.abs(total - 1) < 1e-6) & (F.array_min("p") >= 0)).cast("int").alias("distributions"),
        F.min(F.get("p", F.col("pred")) == F.array_max("p")).cast("int").alias("best_class"))
    value = {c: F.max(F.when(F.col("metric") == c, F.col("value"))) for c in
             ("accuracy", "precision", "recall", "f1", "top1", "top2", "top3", "top5", "top10")}
    x = _mllib_metrics(pred).agg(*[v.alias(c) for c, v in value.items()])
    tops = [F.col(f"top{n}") for n in (1, 2, 3, 5, 10)]
    inside = F.least(*value) >= 0
    grows = F.lit(True)
    for lo, hi in zip(tops, tops[1:]):
        grows = grows & (lo <= hi)
    rates = x.select((inside & (F.greatest(*value) <= 1)).cast("int").alias("rates_in_bounds"),
                     grows.cast("int").alias("topn_monotone"))
    return _as_rows(rows, "fact").unionByName(_as_rows(rates, "fact"))
