"""Python's own slicing, ``str`` methods and ``re`` against the Spark expressions
that must agree with them, and written-out cases of the record parser."""

import random
import re

from pyspark.sql import functions as F

from trylens.functions import text
from trylens.functions.arrays import py_slice
from trylens.operators import spans as SP

RNG = random.Random(7)


def _collect(spark, rows, schema, col):
    return [r["r"] for r in spark.createDataFrame(rows, schema).select(col.alias("r")).collect()]


def test_py_slice_random(spark):
    cases = [([RNG.randint(0, 9) for _ in range(RNG.randint(0, 6))], RNG.randint(-8, 8), RNG.randint(-8, 8))
             for _ in range(400)]
    got = _collect(spark, cases, "a array<int>, s int, e int", py_slice(F.col("a"), F.col("s"), F.col("e")))
    assert got == [a[s:e] for a, s, e in cases]


def test_resplit_and_identifiers_random(spark):
    from trylens.functions.java import JAVA_RESERVED, is_identifier
    alphabet = ["a", "Z", "_", "1", ".", ">", "=", "+", "try", "int", "x.y"]
    cases = [(["".join(RNG.choice(alphabet) for _ in range(RNG.randint(1, 4))) for _ in range(RNG.randint(0, 6))],)
             for _ in range(400)]
    df = spark.createDataFrame(cases, "t array<string>")
    rows = df.select(text.resplit_tokens(F.col("t")).alias("r"),
                     F.transform("t", is_identifier).alias("i")).collect()
    want_r = [[p for tok in t for p in (re.findall(r"\w+|[.]", tok, re.ASCII) if len(tok) > 2 else [tok])]
              for (t,) in cases]
    want_i = [[bool(re.match(r"\w+", tok, re.ASCII)) and not re.match(r"\d+", tok) and tok not in JAVA_RESERVED
               for tok in t] for (t,) in cases]
    assert [r["r"] for r in rows] == want_r
    assert [r["i"] for r in rows] == want_i


def test_python_whitespace_strip_and_split(spark):
    spaces = [c for c in map(chr, range(0x3001)) if c.isspace()]
    alphabet = spaces + list("ab{}();=") + ["é", "ß", "中"]
    cases = [("".join(RNG.choice(alphabet) for _ in range(RNG.randint(0, 12))),) for _ in range(600)]
    df = spark.createDataFrame(cases, "s string")
    rows = df.select(text.py_strip(F.col("s")).alias("a"), text.py_split(F.col("s")).alias("b"),
                     text.py_lstrip(F.col("s")).alias("c")).collect()
    assert [r["a"] for r in rows] == [s.strip() for (s,) in cases]
    assert [r["b"] for r in rows] == [s.split() for (s,) in cases]
    assert [r["c"] for r in rows] == [s.lstrip() for (s,) in cases]


def test_hash_records_written_out(spark):
    rows = [("m,n#a,b,c,d#X,Y#1,2", "X", "m n a", "b c"),
            ("m#a,b#X#0,9", "X", "m ", "a b"),
            ("a#b,c#X#1", None, None, None),           # span without an end
            ("a#b,c#X#q,2", None, None, None),         # span that is no number
            ("a#b#c", None, None, None)]               # three fields
    df = spark.createDataFrame([(r[0],) for r in rows], "v string")
    got = [r["r"] for r in df.select(SP.parse_hash_record(F.col("v")).alias("r")).collect()]
    assert [(g and g["exception"], g and g["front"], g and g["back"]) for g in got] == [r[1:] for r in rows]


def test_malformed_hash_records_are_set_aside(spark):
    df = spark.createDataFrame([("m#a,b#X#0,1",), ("a#b,c#X#1",), ("a#b",), (None,)], "value string")
    good, bad = SP.split_hash_records(df)
    assert good.count() == 1
    assert sorted(r["reason"] for r in bad.collect()) == ["bad span", "too few fields", "too few fields"]
