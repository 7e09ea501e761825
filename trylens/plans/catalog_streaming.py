"""Registered queries: streaming."""

from __future__ import annotations

from ..sources import fixtures as fx
from ..sources.tables import FEEDBACK_SCHEMA, conform_feedback
from ..streaming import handlers as R
from . import flows
from .catalog_models import handler_inputs
from .oracle import with_fixtures
from .registry import ORACLE, query


@query("stream_feedback_sink", with_fixtures("SELECT * FROM feedback", "feedback"))
def stream_feedback_sink(spark, sf_dir):
    sink = R.stream_feedback_sink(spark, fx.feedback(spark, sf_dir))
    return R.read_sink(spark, sink, FEEDBACK_SCHEMA)


@query("stream_predict_handlers", ORACLE["predict_handlers"])
def stream_predict_handlers(spark, sf_dir):
    subs, line_model, type_model = handler_inputs(spark, sf_dir)
    sink = R.stream_predict_handlers(spark, subs, line_model, type_model, fx.class_map(spark))
    return R.read_sink(spark, sink).select("method_id", "exceptionLinesBegin", "exceptionLinesEnd",
                                           "exceptionType", "errorCode", "line_predict")


@query("stream_reply_feedback", ORACLE["record_reply_feedback"])
def stream_reply_feedback(spark, sf_dir):
    """R1 into R2: replies of a stream become feedback rows of a second one."""
    subs, line_model, type_model = handler_inputs(spark, sf_dir)
    replies = R.read_sink(spark, R.stream_predict_handlers(spark, subs, line_model, type_model, fx.class_map(spark)))
    sink = R.stream_feedback_sink(spark, conform_feedback(flows.feedback_records(replies)))
    return R.read_sink(spark, sink, FEEDBACK_SCHEMA)
