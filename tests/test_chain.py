"""The chain over lines against all label sequences."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from trylens.operators import chain


@pytest.mark.parametrize("classes", [2, 3])
def test_best_path_against_all_sequences(spark, classes):
    rng = random.Random(classes)
    first = [round(rng.uniform(-3, 0), 3) for _ in range(classes)]
    following = [[round(rng.uniform(-3, 0), 3) for _ in range(classes)] for _ in range(classes)]
    rows = [([[round(rng.uniform(-5, 0), 3) for _ in range(classes)] for _ in range(n)],) for n in [1, 2, 3, 5, 6] * 8]
    df = spark.createDataFrame(rows, "e array<array<double>>").select("e", chain.best_path(F.col("e"), first, following).alias("p"))

    def total(e, path):
        return sum(x[k] for x, k in zip(e, path)) + first[path[0]] + sum(following[a][b] for a, b in zip(path, path[1:]))
    for e, p in df.collect():
        best = max(total(e, q) for q in itertools.product(range(classes), repeat=len(e)))
        assert len(p) == len(e) and math.isclose(total(e, p), best, abs_tol=1e-9)


def test_empty_and_long_sequences(spark):
    rows = [([],), ([[0.0, -1.0]] * 2000,), (None,)]
    df = spark.createDataFrame(rows, "e array<array<double>>")
    got = [r[0] for r in df.select(chain.best_path(F.col("e"), [0.0, 0.0], [[0.0, -1.0], [-1.0, 0.0]])).collect()]
    assert got[0] == [] and got[1] == [0] * 2000 and not got[2]


def test_ties_go_to_the_smaller_place(spark):
    df = spark.createDataFrame([([[0.0, 0.0]] * 4,)], "e array<array<double>>")
    assert df.select(chain.best_path(F.col("e"), [0.0, 0.0], [[0.0, 0.0], [0.0, 0.0]])).first()[0] == [0, 0, 0, 0]


def test_transitions_and_weights(spark):
    df = spark.createDataFrame([([0, 0, 1],), ([1],), ([],), (None,), ([1, None, 0],)], "labels array<int>")
    t = chain.fit_transitions(df)
    assert {(r["prev"], r["next"]): r["n"] for r in t.collect()} == {(None, 0): 1, (None, 1): 2, (0, 0): 1, (0, 1): 1, (1, 0): 1}
    first, following = chain.chain_weights(t, [0, 1])
    assert first == [round(math.log(2 / 5), 6), round(math.log(3 / 5), 6)]
    assert following == [[round(math.log(0.5), 6)] * 2, [round(math.log(2 / 3), 6), round(math.log(1 / 3), 6)]]
    with pytest.raises(ValueError):
        chain.chain_weights(t, list(range(chain.MAX_CLASSES + 1)))


def test_context_decides_an_unclear_line(spark):
    """A line whose words say little takes the label its neighbours suggest."""
    score = lambda a, b: [{"class_id": 0, "score": a}, {"class_id": 1, "score": b}]
    rows = [(1, 1, score(-9.0, -1.0)), (1, 2, score(-1.0, -1.1)), (1, 3, score(-9.0, -1.0)), (2, 1, score(-1.0, -1.1))]
    lines = spark.createDataFrame(rows, "method_id int, line_no int, scores array<struct<class_id:int,score:double>>")
    t = spark.createDataFrame([(None, 0, 50), (None, 1, 50), (0, 0, 90), (0, 1, 10), (1, 0, 10), (1, 1, 90)], "prev int, next int, n long")
    got = {(r["method_id"], r["line_no"]): r["class_id"] for r in chain.score_sequences(lines, t).collect()}
    assert got == {(1, 1): 1, (1, 2): 1, (1, 3): 1, (2, 1): 0}
    assert chain.score_sequences(lines.limit(0), t).count() == 0
