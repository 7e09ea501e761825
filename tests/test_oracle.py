"""Every registered query with an oracle gives the same rows as DuckDB (sf 0.001)."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from tools.oracle_check import rows_of, type_mismatches

ORACLE = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLE[name])
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert type_mismatches(df, res) == []
    assert rows_of(df.columns, s_rows) == rows_of(d_cols, d_rows)


def test_every_query_registered_runs_or_has_oracle():
    qs = entry.queries()
    assert set(ORACLE) <= set(qs)
    assert len(qs) >= 85 and len(ORACLE) >= 84


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:4] == ["method_id", "exceptionLinesBegin", "exceptionLinesEnd", "exceptionType"]
