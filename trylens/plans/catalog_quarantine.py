"""Registered queries: inputs routed to kept and set-aside rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import quarantine as Q
from ..sources import fixtures as fx
from ..sources import text as TX
from . import oracle_exprs as X
from .catalog_labels import P7_SQL
from .catalog_slicing import _oracle, sliced
from .oracle import with_fixtures
from .registry import query


def _both(routed, *columns):
    """Both sides with their verdict; kept + set aside = input is the counts' job."""
    kept, aside, counts = routed
    assert kept.count() == counts[Q.KEPT] and aside.count() == counts[Q.SET_ASIDE]
    none = F.lit(None).cast("string").alias("reason")
    return kept.select(*columns, F.lit(Q.KEPT).alias("verdict"), none).unionByName(
        aside.select(*columns, F.lit(Q.SET_ASIDE).alias("verdict"), "reason"))


@query("route_hash_records", with_fixtures(
    """SELECT id, CASE WHEN bad OR id % 50 = 0 THEN 'set_aside' ELSE 'kept' END AS verdict,
 CASE WHEN id % 50 = 0 THEN 'too few fields' WHEN bad THEN 'bad span' END AS reason
 FROM (SELECT id, id % 7 = 3 AND id % 50 <> 0 AS bad FROM hash_records)""", "hash_records"))
def route_hash_records(spark, sf_dir):
    h = fx.hash_records(spark, sf_dir)
    # every seventh span loses its second number
    h = h.withColumn("value", F.when(F.col("id") % 7 == 3, F.regexp_replace("value", r"(\d+),\d+$", "$1,x")).otherwise(F.col("value")))
    return _both(Q.route_hash_records(h), "id")


@query("route_sliced_methods", _oracle(
    """SELECT method_id, CASE WHEN ok THEN 'kept' ELSE 'set_aside' END AS verdict,
 CASE WHEN NOT ok THEN 'at most one token kept' END AS reason
 FROM (SELECT method_id, coalesce(list_sum(mask), 0) > 1 AS ok FROM d_mask)""", 6))
def route_sliced_methods(spark, sf_dir):
    return _both(Q.route_sliced(sliced(spark, sf_dir)), "method_id")


@query("route_training_triples", with_fixtures(
    f"""SELECT pos, in_try, before_try, label_text, CASE WHEN reason IS NULL THEN 'kept' ELSE 'set_aside' END AS verdict, reason FROM (
 SELECT *, CASE WHEN label_text IS NULL THEN 'no line in label_text' WHEN label_text = 'none' THEN 'label is no integer' END AS reason FROM (
 SELECT pos, in_try, before_try, CASE WHEN pos < n - n // 10 THEN label END AS label_text FROM (
 SELECT row_number() OVER (ORDER BY t.method_id) - 1 AS pos, count(*) OVER () AS n, {X.strip('t.tgt')} AS in_try, {X.strip('m.src')} AS before_try,
  CASE WHEN c.class_id IS NULL THEN 'none' ELSE CAST(c.class_id AS VARCHAR) END AS label
 FROM (SELECT method_id, tgt, {P7_SQL} AS exception FROM targets) t JOIN methods m ON m.method_id = t.method_id
 LEFT JOIN class_map c ON c.name = t.exception)))""", "methods", "class_map"))
def route_training_triples(spark, sf_dir):
    m = L.exception_types(fx.methods(spark, sf_dir))
    lab = m.join(F.broadcast(fx.class_map(spark)), F.col("exception") == F.col("name"), "left") \
           .withColumn("label", F.coalesce(F.col("class_id").cast("string"), F.lit("none")))
    a = TX.read_positional(spark, TX.write_lines(lab, "tgt", ["method_id"], "in_try"), "in_try")
    b = TX.read_positional(spark, TX.write_lines(lab, "src", ["method_id"], "before_try"), "before_try")
    c = TX.read_positional(spark, TX.write_lines(lab, "label", ["method_id"], "labels"), "label_text")
    n = a.count()
    c = c.where(F.col("pos") < n - n // 10)              # the label file ends early
    return _both(Q.route_training_triples(a, b, c), "pos", "in_try", "before_try", "label_text")
