"""Predicted try spans and try-block insertion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, py_slice


def find_predicted_span(preds: Column, closed_runs: bool = False, fix_line0: bool | None = None) -> Column:
    """0/1 line predictions -> struct(begin, end).

    begin = index of the first 1 (-1 if none).  end = index before the first 0
    after begin, but only when begin > 0: a run that starts at line 0 never
    closes (the reference tests ``begin > 0``).  No closing 0 -> end = len.
    ``closed_runs=True`` (alias ``fix_line0``) closes runs that start at
    line 0 as well; off by default so results match the reference.
    """
    if fix_line0 is not None:
        closed_runs = fix_line0
    def body(p):
        begin = (F.array_position(p, 1) - 1).cast("int")
        rest = F.slice(p, begin + 2, F.greatest(F.size(p) - begin - 1, F.lit(0)))
        k = F.when(begin >= 0, F.array_position(rest, 0)).otherwise(F.lit(0)).cast("int")
        opens = (begin >= 0) if closed_runs else (begin > 0)
        end = F.when(opens & (k > 0), begin + k - 1).otherwise(F.size(p))
        return F.struct(begin.alias("begin"), end.cast("int").alias("end"))
    return let(preds, body)


def insert_try_block(lines: Column, begin: Column, end: Column) -> Column:
    """P5: wrap lines ``[begin, end]`` in ``try { ... } catch ( Exception e ) { }``.

    Python slice rules throughout, so ``begin = -1`` keeps all but the last
    line in front and moves the last line into the block.
    """
    nl = F.lit("\n")
    return F.concat(
        F.array_join(py_slice(lines, 0, begin), "\n"), nl,
        F.lit("try {"), nl,
        F.array_join(py_slice(lines, begin, end + 1), "\n"), nl,
        F.lit("} catch ( Exception e ) { } "), nl,
        F.array_join(py_slice(lines, end + 1, None), "\n"))


def parse_hash_record(value: Column) -> Column:
    """S4 + P6 + P8: ``input#tok,...#exc,...#begin,end`` -> typed struct.

    Null when the record is malformed: fewer than four fields (F3), or a span
    that is not two integers.  ``front`` is the
    input with commas as spaces plus tokens ``[0, begin)``; ``back`` is tokens
    ``[begin, end]`` inclusive, with Python slice clamping.
    """
    def body(f):
        toks = F.split(F.get(f, 1), ",", -1)
        span = F.split(F.get(f, 3), ",", -1)
        b = F.trim(span[0]).try_cast("int")
        e = F.trim(F.regexp_replace(F.get(span, 1), "\n", "")).try_cast("int")
        return F.when((F.size(f) >= 4) & b.isNotNull() & e.isNotNull(), F.struct(
            f[0].alias("method_input"),
            toks.alias("tokens"),
            F.split(F.get(f, 2), ",", -1)[0].alias("exception"),
            b.alias("begin"), e.alias("end"),
            F.concat(F.translate(f[0], ",", " "), F.lit(" "),
                     F.array_join(py_slice(toks, 0, b), " ")).alias("front"),
            F.array_join(py_slice(toks, b, e + 1), " ").alias("back")))
    return let(F.split(value, "#", -1), body)


def split_hash_records(records: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(parsed rows with a ``record`` struct, set-aside rows with a ``reason``):
    one malformed record costs one row, never the job."""
    x = records.withColumn("record", parse_hash_record(F.col(value_col)))
    fields = F.size(F.split(F.coalesce(F.col(value_col), F.lit("")), "#", -1))
    bad = x.where(F.col("record").isNull()).drop("record")
    return (x.where(F.col("record").isNotNull()),
            bad.withColumn("reason", F.when(fields < 4, "too few fields").otherwise("bad span")))
