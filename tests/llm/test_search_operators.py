"""Operators 11 to 13 against brute-force versions, and their edge cases."""

import itertools
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from trylens.llm import hard_negatives as hn
from trylens.llm import simhash, spelling

RNG = np.random.default_rng(3)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["*", "1 AS fp", "2 AS node", "'k' AS word", "3 AS n", "4 AS uid", "5 AS cell", "6 AS label2"]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).selectExpr(*EXTRA)


# ---- simhash

def majority(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    h = [xxhash.xxh64(b" ".join(words[i:i + 3]), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_rows():
    base = [f"w{i}" for i in RNG.integers(0, 400, 300)]
    texts = [None, "", " \t\n", "One", "one ", "one TWO", "é Ünï\x0bcode  x", "a b c a b c", "x " * 500]
    for _ in range(120):                               # near copies of a long text: many links of one and two bits
        w = list(base)
        for k in RNG.integers(0, 300, RNG.integers(0, 3)):
            w[k] = f"z{RNG.integers(0, 50)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"w{i}" for i in RNG.integers(0, 60, 12)) for _ in range(80)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    return rows + [rows[20], (None, texts[21], None, None, None), (None, "alone here", None, None, None)]


def test_fingerprint_is_the_majority(monkeypatch):
    monkeypatch.setattr(simhash, "_BLOCK", 7)          # long texts are hashed block by block
    for r in simhash_rows():
        assert simhash.fingerprint((r[1] or "").encode()) == majority(r[1])


@pytest.mark.parametrize("parts,tile", [(1, 512), (2, 5), (4, 512), (8, 3), (16, 512)])
def test_simhash_components(spark, monkeypatch, parts, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rows = simhash_rows()
    fps = [majority(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            up[find(i)] = find(j)
    want = Counter()
    for i, r in enumerate(rows):
        ids = [q[0] for j, q in enumerate(rows) if find(j) == find(i) and q[0] is not None]
        want[(r[0], f"{fps[i]:016x}", min(ids, default=None))] += 1
    got = simhash.near_duplicates(frame(spark, rows), parts)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(map(tuple, got.collect())) == want


def test_simhash_steps_cover_the_radius():
    for parts in (1, 2, 4, 8, 16):
        steps = set(simhash.count_steps(parts))
        base = 64 // parts + 5
        assert 0 in steps and len(steps) == len({abs(s) for s in steps})
        for i, j in itertools.product(range(parts), repeat=2):
            for a, b in itertools.product((-1, 1), repeat=2):
                assert abs(a * base ** i + b * base ** j) in steps


def test_simhash_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


# ---- spelling

def brute_words(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words):
    near = defaultdict(list)
    for a, b in itertools.combinations(words, 2):
        if is_near(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, ns in near.items():
        best = min(ns, key=lambda x: (-words[x], x))
        if words[best] >= 10 * words[w]:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


def edited(word, letters):
    at, kind = RNG.integers(0, len(word)), RNG.integers(0, 3)
    x = letters[RNG.integers(0, len(letters))]
    return word[:at] + ("" if kind == 0 else x) + word[at + (kind < 2):]


def spelling_words(letters, lengths, many):
    words = Counter()
    for k in range(many):
        w = "".join(RNG.choice(list(letters), RNG.choice(lengths)))
        words[w] += int(10 ** RNG.integers(0, 5)) + 2
        for _ in range(6):
            w = edited(w, letters)
            if len(w) >= 7:
                words[w] += int(10 ** RNG.integers(0, 4)) + 2
    return dict(words)


@pytest.mark.parametrize("letters,lengths", [("ab", [7, 8, 9]), ("abcdeéÿ×", [7, 8, 11, 14]), ("ab", [30, 61, 200])])
def test_near_words_and_roots(spark, letters, lengths):
    words = spelling_words(letters, lengths, 60)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert set(map(tuple, spelling.variants(df).collect())) == brute_variants(words)


def test_long_chain_of_forms(spark):
    words = {"aaaaaaa" + "b" * k: 2 * 10 ** k for k in range(9)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: r["root"] for r in spelling.variants(df).collect()}
    assert set(got.values()) == {"aaaaaaa" + "b" * 8}


def test_spelling_counts_whole_texts(spark):
    vocab = ["".join(RNG.choice(list("abcdefghé"), RNG.integers(5, 12))) for _ in range(80)]
    rows = [(i if i % 9 else None, " ".join(RNG.choice(vocab, 200)).replace("a", "A") + ",1x_" + "Wordword" * 300, None, None, None)
            for i in range(40)]
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (1002, "12 .,", None, None, None), rows[3], rows[3]]
    words = brute_words(rows)
    got = spelling.spelling_variants(frame(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert set(map(tuple, got.collect())) == brute_variants(words) and got.count() == len(words)


def test_spelling_flushes_often(spark, monkeypatch):
    rows = [(i, " ".join(f"letters{'abcdefghij'[j]}" for j in range(10)), None, None, None) for i in range(30)]
    monkeypatch.setattr(spelling, "_FLUSH", 2)
    assert dict(map(tuple, spelling.word_counts(frame(spark, rows)).collect())) == brute_words(rows)


def test_spelling_empty_table(spark):
    assert spelling.spelling_variants(frame(spark, [])).count() == 0
    assert spelling.spelling_variants(frame(spark, [(1, None, None, None, None)])).count() == 0


# ---- hard negatives

EMB = "vec_id long, embedding array<float>, label int"


def brute_negatives(rows, every=50):
    ok = {}
    for i, e, lab in rows:
        if i is None or lab is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        lab = (lab + 1) % 10 if i % 7 == 0 else lab
        ok[(i, lab, tuple(int(np.floor(256 * float(np.float32(x)))) for x in e))] = None
    rs = list(ok)
    out = set()
    for ai, al, av in rs:
        if ai % every:
            continue
        score = lambda v: sum(x * y for x, y in zip(av, v))
        pos = sorted(((-score(v), i) for i, lab, v in rs if lab == al and i != ai))[:5]
        for ps, pid in ((-s, i) for s, i in pos):
            neg = sorted((-score(v), i) for i, lab, v in rs if lab != al
                         and Fraction(50 * ps, 100) <= score(v) <= Fraction(95 * ps, 100))[:3]
            out |= {(ai, pid, k + 1, ni, ps, -s) for k, (s, ni) in enumerate(neg)}
    return out


def emb_rows(n, dim, labels, spread):
    return [(i, [float(x) for x in np.round(RNG.normal(0, spread, dim), 1)], int(RNG.integers(0, labels))) for i in range(n)]


@pytest.mark.parametrize("n,dim,labels,spread", [(300, 3, 4, 0.3), (300, 6, 2, 5.0), (200, 4, 10, 300.0)])
def test_hard_negatives(spark, monkeypatch, n, dim, labels, spread):
    monkeypatch.setattr(hn, "_SCORES", 64)
    rows = emb_rows(n, dim, labels, spread)
    df = spark.createDataFrame(rows, EMB).selectExpr("*", "7 AS uid", "8 AS cell", "'x' AS score")
    want = brute_negatives(rows, 10)
    assert want and set(map(tuple, hn.hard_negatives(df, 10).collect())) == want


def test_hard_negatives_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(hn, "ANCHORS", 4)
    monkeypatch.setattr(hn, "ROWS", 50)
    rows = emb_rows(400, 4, 3, 0.5)
    rows += [(1000 + i, rows[0][1], 1) for i in range(60)]           # a common vector: ties by id
    df = spark.createDataFrame(rows, EMB)
    assert set(map(tuple, hn.hard_negatives(df, 10).collect())) == brute_negatives(rows, 10)


def test_hard_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = emb_rows(150, 3, 3, 0.4)
    rows += [(200, None, 1), (250, [1.0, None, 2.0], 1), (300, [nan, 1.0, 1.0], 1), (350, [inf, 1.0, 1.0], 1),
             (400, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (450, [], 1), (500, [1.0], 2),
             (550, [0.5, 0.25, 0.125, 9.0], 0), rows[3], rows[50], rows[50], (600, [1e30, 1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, EMB)
    want = brute_negatives([r for r in rows if r[0] != 600])
    assert set(map(tuple, hn.hard_negatives(df).collect())) == want


def test_hard_negatives_without_rows(spark):
    assert hn.hard_negatives(spark.createDataFrame([], EMB)).count() == 0
    assert hn.hard_negatives(spark.createDataFrame([(50, [1.0, 2.0], 1)], EMB)).count() == 0
