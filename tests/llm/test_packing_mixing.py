"""Packing plans against bounds, token ids of all Latin letters, and the mix
against a plain walk in hash order."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from trylens.llm import mixing, packing
from trylens.llm.queries import tokenizer_path

RNG = np.random.default_rng(8)


def sequences(hist, capacity, groups):
    got = Counter()
    for many, slots in groups:
        assert sum(n * k for n, k in slots) <= capacity
        for n, k in slots:
            got[n] += many * k
    assert got == Counter(hist)
    return sum(m for m, _ in groups)


def best_fit_alone(hist, capacity):
    return sum(m for m, _, _ in packing.groups_best_fit([], dict(hist), capacity))


@pytest.mark.parametrize("hist,want", [
    ({1365: 3000}, 1000), ({2047: 100, 2049: 100}, 100), ({819: 5000, 1365: 100}, 1034),
    ({1366: 3000, 1365: 3000, 1400: 500}, 2500), ({4096: 3, 1: 1}, 4), ({1: 5000}, 2), ({4095: 2, 1: 2}, 2), ({}, 0)])
def test_exact_lengths(hist, want):
    assert sequences(hist, 4096, packing.plan_groups(hist, 4096)) == want


@pytest.mark.parametrize("seed", range(6))
def test_never_worse_than_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    draws = (rng.integers(1, 1001, 3000), rng.integers(300, 500, 2000), (rng.lognormal(4.5, 1.2, 4000)).clip(1, 1000),
             rng.choice([334, 333, 500, 501, 250, 167], 2000), rng.integers(990, 1001, 50), rng.integers(1, 4, 10))
    hist = dict(Counter(draws[seed].astype(int).tolist()))
    for classes in (packing.CLASSES, 20):
        n = sequences(hist, 1000, packing.plan_groups(hist, 1000, classes, iterations=200))
        assert math.ceil(sum(k * v for k, v in hist.items()) / 1000) <= n <= best_fit_alone(hist, 1000)


def test_dearest_configuration():
    rng = np.random.default_rng(1)
    for _ in range(30):
        size = np.unique(rng.integers(1, 30, 5))
        price = rng.random(len(size))
        best = [0.0] * 61
        for u in range(1, 61):
            best[u] = max([best[u - 1]] + [best[u - s] + p for s, p in zip(size.tolist(), price.tolist()) if s <= u])
        copies = packing.best_configuration(price, size, 60)
        assert (copies * size).sum() <= 60 and math.isclose((copies * price).sum(), best[60], rel_tol=1e-9)


def test_ids_of_every_latin_code_point():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    texts = [f"{a}{chr(i)}{b}" for i in range(0x250) if not 0xD800 <= i < 0xE000 for a, b in (("a", "b"), ("1", "!"), ("", " x"))]
    got = packing.RunIds(tokenizer_path())([t.encode() for t in texts])
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def hash_of(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)


def walk(rows, targets):
    """Copies of each row: whole copies, then documents in hash order while they
    fit; behind one that does not, those no larger than what is left."""
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    out = []
    for source, rs in by.items():
        size = {id(r): len((r[1] or "").split()) for r in rs}
        total = sum(size.values())
        whole = min(3, int(targets[source] // total)) if total else 0
        left = math.floor(targets[source] - whole * total)
        groups = defaultdict(list)
        for r in rs:
            groups[hash_of(r[0])].append(r)
        taken, begin = set(), -1
        for k in range(mixing.PASSES):
            limit, rest, stop = left, left, None
            for u in sorted(groups):
                if u <= begin:
                    continue
                part = [r for r in groups[u] if k == 0 or size[id(r)] <= limit]
                words = sum(size[id(r)] for r in part)
                if words > rest and part:
                    stop = u
                    if k == mixing.PASSES - 1 and words < 2 * rest:
                        taken |= {id(r) for r in part}
                    break
                rest -= words
                taken |= {id(r) for r in part}
            if stop is None:
                break
            begin, left = stop, rest
        out += [(r[0], size[id(r)], min(3, whole + (id(r) in taken))) for r in rs]
    return Counter(out)


def mix_rows():
    rows = []
    for i in range(300):
        n = int(RNG.lognormal(3, 1.5)) if i % 7 else 0
        rows.append((i, " ".join(["w"] * n) if i % 11 else None, f"s{i % 5}" if i % 13 else None, 0))
    return rows + [(5, "a b c", "s1", 0), (5, "a b c d e f", "s4", 0), rows[9], (None, "x y", "s2", 0), (None, None, None, 0)]


def test_mix_against_a_plain_walk(spark):
    rows = mix_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS size", "2 AS u", "3 AS copies", "4 AS cut0", "5 AS row")
    got = mixing.mix(docs).collect()
    targets = {r["source"]: r["target"] for r in mixing.targets(mixing.sized(docs)).collect()}
    want = walk(rows, targets)
    assert Counter((r["doc_id"], r["size"], r["copies"]) for r in got) == want
    # rows of one doc_id in two sources keep their own numbers
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    n = Counter()
    for (i, size, k), many in want.items():
        n[(i, size)] += k * many
    assert Counter((r["doc_id"], len((r["text"] or "").split())) for r in mixed.collect()) == +n


def test_taken_words_come_near_the_target(spark):
    rows = [(i, "w " * int(RNG.lognormal(3.5, 1)), f"s{i % 4}", 0) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for r in got:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 0.02 * r["max(target)"]
