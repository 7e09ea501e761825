"""Each operator against a brute-force statement on small data, and the edge
cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra
columns with clashing names."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trylens.llm import (digest, html_extract, jaccard, langid, line_dedup, mixing, packing, quality, repetition,
                         sharding)
from trylens.llm import common as c
from trylens.llm.queries import tokenizer_path

RNG = np.random.default_rng(5)
VOCAB = [f"w{i}" for i in range(60)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def sentence(n):
    return " ".join(RNG.choice(VOCAB, n))


def corpus():
    long = sentence(3000)
    base = [sentence(80) for _ in range(12)]
    passage = "\n".join(sentence(30) for _ in range(3))
    texts = base + [base[0], base[1] + " tail", base[2].replace("w1 ", "q "), None, "", " \n\t ", "one two", "One  TWO",
                    long, long + " x", "a\n" + passage + "\nb", "c\n" + passage, passage, "x " * 70,
                    "\n".join([sentence(60)] * 3), "é ü " * 40]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 0) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, base[4], None, None, None), (None, None, None, None, None)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns whose names the operators use themselves
    return spark.createDataFrame(ROWS, DOCS).selectExpr("*", "1 AS size", "'k' AS kept", "2 AS rank", "3 AS cls", "4 AS u")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_packing_places_every_token(spark, docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(docs, tokenizer_path(), capacity=256, keep_ids=True).collect()
    want = Counter(tuple(tok.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in ROWS)
    by = {}
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"]
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    pieces = sorted((r["start"], tuple(r["ids"])) for r in rows)
    assert pieces == sorted((s, ids[s:s + 256]) for ids, k in want.items() for _ in range(k) for s in range(0, len(ids), 256))


def test_packing_plan_is_near_the_bound():
    lengths = RNG.integers(1, 600, 4000)
    hist = dict(Counter(lengths.tolist()))
    groups = packing.plan_groups(hist, 1000)
    got = Counter()
    for many, slots in groups:
        assert sum(n * k for n, k in slots) <= 1000
        for n, k in slots:
            got[n] += many * k
    assert got == Counter(hist)
    assert sum(m for m, _ in groups) <= 1.01 * lengths.sum() / 1000 + 2


@pytest.mark.parametrize("text", ["it's 'S x’s", "a<|endoftext|>b", "ΑΣ ΣΑΣ", "\x1c a\x85b c", "İI ﬁ", "!!!' 12a½"])
def test_run_ids_equal_the_tokenizer(text):
    from tokenizers import Tokenizer
    want = Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
    got = packing.RunIds(tokenizer_path())([text.encode()])[0]
    assert np.frombuffer(got, dtype="<u4").tolist() == want


def test_quality_scores_held_out_rows(spark):
    docs, labels = (c.table(spark, SF, n) for n in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert len(quality.quality_scores(docs, labels).collect()) == docs.count()
    assert ((got.score >= 0) & (got.score <= 1)).all() and (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert held.score[held.quality == 1].mean() > held.score[held.quality == 0].mean()


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality_scores(docs, none).collect()} == {0.5}


def brute_components(rows):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            up[find(i)] = find(j)
    out = Counter()
    for i, r in enumerate(rows):
        ids = [q[0] for j, q in enumerate(rows) if find(j) == find(i) and q[0] is not None]
        out[(r[0], len(sets[i]), (min(ids) if ids else None) if sets[i] else r[0])] += 1
    return out


def test_jaccard_components(spark, docs):
    got = Counter(tuple(r) for r in jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(ROWS)


def test_jaccard_tiles_of_common_shingles(spark, monkeypatch):
    """Many near copies, tiny blocks: the block tiles find what leaders miss."""
    base = sentence(100).split()
    rows = []
    for i in range(40):
        w = list(base)
        for k in RNG.integers(0, 100, 2):
            w[k] = f"z{i}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard, "TILE", 4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in jaccard.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows)


def test_bitmap_bound_never_rejects_a_link():
    for _ in range(300):
        n = int(RNG.integers(1, 400))
        a = np.unique(RNG.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[RNG.random(len(a)) < 0.93], RNG.integers(0, 1 << 63, n // 20, dtype=np.uint64)]))
        if len(b) and jaccard.links(a, b):
            assert jaccard.may_link(jaccard.parity_bitmap(a), jaccard.parity_bitmap(b), len(a), len(b))


def test_jaccard_keeps_one(spark, docs):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    got = Counter(r["doc_id"] for r in kept.collect())
    comps = {k[0]: k[2] for k in brute_components(ROWS) if k[0] is not None}
    assert all(n == 1 for i, n in got.items() if i is not None)
    assert {i for i in got if i is not None} == {i for i, m in comps.items() if i == m}


PAGE = ("<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav>"
        "<div class='ad'>Buy</div><article><h1>Head &amp; more</h1><p>One  two<p>Three<br>four</p>"
        "<form><p>mail</p></form><div class=comments><p>first!</p></div></article><footer>&copy;</footer>")


def test_html_extraction(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.replace("Three", f"Three{i}")) for i in range(4)]
    rows += [(9, None, None), (10, "x", ""), (11, "http://o.example/", "<p>only <b>text</b></p>"), (11, "http://o.example/", "a<b")]
    got = {(r["page_id"], r["text"], r["n_chars"]) for r in
           html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(4):
        t = f"Head & more\nOne two\nThree{i} four"
        assert (i, t, len(t)) in got
    assert (9, "", 0) in got and (10, "", 0) in got and (11, "only text", 9) in got
    assert len(got) == 8


def brute_repeats(words, k):
    """Covered words and longest repeat from all pairs of positions."""
    n, covered, longest = len(words), set(), 0
    for i, j in itertools.combinations(range(n), 2):
        m = 0
        while j + m < n and words[i + m] == words[j + m]:
            m += 1
        longest = max(longest, m)
        if m >= k:
            covered.update(range(i, i + m), range(j, j + m))
    return len(covered), longest


def texts_of(spark, pages):
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


def test_html_classes_choose_the_text(spark):
    # names say the opposite of what varies; lines inside the extracted element stay, on any number of pages
    page = ("<body><article><p>About this site, its owners and its long history since the first day</p></article>"
            "<div class=widget><h1>Title {0}</h1><p>Story {0} a</p><p>Story {0} b</p><p>Share this story</p></div></body>")
    for n in (2, 4, 5, 6):
        assert texts_of(spark, [page.format(i) for i in range(n)]) == [
            f"Title {i}\nStory {i} a\nStory {i} b\nShare this story" for i in range(n)]


def test_html_recurring_headings_stay_on_hosts_of_any_size(spark):
    page = ("<body><div class=top>Site</div><div class=content><h1>Cake {0}</h1><h2>Ingredients</h2><p>flour {0}</p>"
            "<h2>Method</h2><p>stir {0}</p></div></body>")
    for n in (4, 5):
        assert texts_of(spark, [page.format(i) for i in range(n)]) == [
            f"Cake {i}\nIngredients\nflour {i}\nMethod\nstir {i}" for i in range(n)]


def test_html_pages_of_open_tags_take_one_pass():
    import time
    begun = time.time()
    for page in ("<a " * 300000, "<div>" * 150000, '<a "x>" ' * 100000, "<div>" * 80000 + "</x>" * 80000):
        for _ in html_extract.events(page):
            pass
    assert time.time() - begun < 60
    assert [t for k, _, t, *_ in html_extract.events('<p title="a>b">x</p><i q=">y<p>z') if k == "text"] == ["x", "y", "z"]


def test_names_of_equal_tags_are_read_once(monkeypatch):
    """Attributes and asides are looked up by their text, and a name with quotes stays one name."""
    reads = []

    class Counted:
        def __init__(self, pattern):
            self.pattern = pattern

        def findall(self, text):
            reads.append(text)
            return self.pattern.findall(text)

        def search(self, text):
            reads.append(text)
            return self.pattern.search(text)
    monkeypatch.setattr(html_extract, "_NAME", Counted(html_extract._NAME))
    monkeypatch.setattr(html_extract, "_ASIDE_NAME", Counted(html_extract._ASIDE_NAME))
    page = "<div class='once-only side'>a</div>\n" * 500 + "<div class='sidebar once-only'>b</div>"
    got = [(e[2], e[1].path, e[1].aside) for e in html_extract.events(page) if e[0] == "text"]
    assert got == [("a", "#/div.once-only side", False)] * 500 + [("b", "#/div.once-only sidebar", True)]
    assert len(reads) <= 4
    # a quote in a tag's name belongs to the name; its tags then end at the next >
    assert [e[2] for e in html_extract.events("<p'x>a</p>") if e[0] == "text"] == ["a"]


def test_html_empty_table_and_clashing_columns(spark):
    rows = [(i, "http://h/", f"<body><div><h1>T{i}</h1><p>a{i}</p></div></body>") for i in range(2)]
    schema = "page_id long, url string, html string"
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0
    wide = spark.createDataFrame(rows, schema).selectExpr("*", "'x' AS host", "1 AS members", "2 AS take", "3 AS token", "'y' AS text")
    assert sorted(r["text"] for r in html_extract.extract(wide).collect()) == ["T0\na0", "T1\na1"]


def test_html_classes_nest_by_order(spark):
    # two once-a-page elements that change places on one page are no valid class; their text stays with the slot around
    a, b = "<div class=a>First {0} of the text</div>", "<div class=b>Then {0} of the text</div>"
    pages = ["<body><div class=c><h1>T{0}</h1>" + (a + b if i else b + a) + "</div><div class=d>x</div></body>" for i in range(3)]
    got = texts_of(spark, [p.format(i) for i, p in enumerate(pages)])
    assert got[0] == "T0\nThen 0 of the text\nFirst 0 of the text"
    assert got[1] == "T1\nFirst 1 of the text\nThen 1 of the text"
    t = html_extract.Template([{"token": html_extract._key(f"#/{x}"), "vector": v, "is_text": False, "fixed": False}
                               for x, v in (("h1", 1), ("div", 2), ("div/i-x", 2), ("h2", 1))])
    slots = [(e[0], e[1]) for e in t.run("<h1>a</h1>b<div>c<i-x>d</i-x>e</div>f<h2>g</h2>")]
    named = {2 * html_extract._key(f"#/{x}") + end: f"{'/' * end}{x}" for x in ("h1", "div", "div/i-x", "h2") for end in (0, 1)}
    assert [named[s] for kind, s in slots if kind == "text"] == [
        "h1", "/h1", "div", "div/i-x", "/div/i-x", "/h1", "h2"]


def test_html_repeated_children_count_for_their_slot(spark):
    page = "<body><div class=top>Site</div><div class=content><h1>T{0}</h1><p>a{0}</p><p>b{0}</p></div></body>"
    assert texts_of(spark, [page.format(i) for i in range(2)]) == [f"T{i}\na{i}\nb{i}" for i in range(2)]
    same = "<body><div class=top>Site</div><div class=content><h1>T</h1><p>a</p><p>b</p></div></body>"
    assert all(t.endswith("T\na\nb") for t in texts_of(spark, [same, same]))


def test_html_single_paragraph_keeps_its_heading(spark):
    page = "<body><div class=x>Ad {0}</div><div class=content><h1>T{0}</h1><p>" + "long text " * 9 + "{0}</p></div></body>"
    assert texts_of(spark, [page.format(i) for i in range(2)]) == [
        f"T{i}\n" + "long text " * 9 + str(i) for i in range(2)]


@pytest.mark.parametrize("head, lost", [
    ("<datalist><option value=x></datalist>", ""), ("<select><option>1<option>2</select>", ""), ("<button>go", ""),
    ("<svg><path d=m>", ""), ("<noscript><p>", ""), ("<textarea>", ""), ("<script>", "all")])
def test_html_unclosed_elements_end_with_their_parent(spark, head, lost):
    page = f"<body><header>{head}</header><article><h1>T</h1><p>Text <math><mi>x</mi>=1</math> end</p></article></body>"
    assert html_extract.main_text(page, html_extract.Template([]), set(), False) == ("" if lost else "T\nText x=1 end")


def test_repetition_equals_brute_force():
    texts = []
    for _ in range(30):
        w = RNG.choice(list("abc"), int(RNG.integers(0, 60))).tolist()
        if len(w) > 20:
            w += w[3:18]
        texts.append(" ".join(w))
    m = repetition.measure([t.encode() for t in texts], min_repeat=6)
    for k, t in enumerate(texts):
        w = t.split()
        three = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        twice = {x for x, n in Counter(three).items() if n > 1}
        rep = {i + j for i, x in enumerate(three) if x in twice for j in range(3)}
        assert (m["n_covered_words"][k], m["longest_repeat"][k]) == brute_repeats(w, 6)
        assert m["n_repeat_words"][k] == len(rep) and m["n_words"][k] == len(w)


def test_repetition_limits_reject_what_the_base_rule_keeps():
    words = [f"u{i}" for i in range(3000)]
    pasted = words[:760] + words[100:340]                               # 48 % of 1,000 words
    scattered = words[:900] + [w for k in range(0, 100, 10) for w in words[8 * k:8 * k + 10]]
    passage = words[:2880] + words[500:620]                             # 8 % of 3,000 words
    short = words[:2900] + words[500:590] + words[:10]                  # under both limits
    m = repetition.measure([" ".join(x).encode() for x in (pasted, scattered, passage, short)])
    n = m["n_words"]
    covered = m["n_covered_words"] > repetition.MAX_COVERED * n
    longest = (m["longest_repeat"] > repetition.MAX_LONGEST * n) & (m["longest_repeat"] >= repetition.LONGEST_FLOOR)
    assert covered.tolist() == [True, True, False, False] and longest.tolist() == [True, False, True, False]
    failed, kept = repetition.verdict(m)
    assert not failed.any() and kept.tolist() == [False, False, False, True]


def test_quality_rules_rows_and_filter(spark, docs, empty):
    rows = repetition.quality_rules(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[12]["kept"] and not by[15]["kept"] and by[15]["n_words"] == 0
    x70 = next(r for r in rows if r["n_words"] == 70)
    assert x70["base_failed"] and x70["n_repeat_words"] == 70
    kept = repetition.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)
    assert repetition.keep_good(empty).count() == 0


def test_fingerprints_follow_the_next_document(spark, docs):
    rows = [(r[0], r[1] or "") for r in ROWS if r[0] is not None and r[0] != 3]
    df = spark.createDataFrame(rows[::-1], "doc_id long, text string")
    got = {r["doc_id"]: r for r in digest.fingerprints(df, ranges=5).collect()}
    assert len(got) == len(rows)
    import hashlib
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        e = digest.edited(t, after)
        assert got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert got[i]["fingerprint"] == digest.to_hex(digest.digest(t.encode()))
        assert got[i]["near_next"] == digest.likeness(digest.digest(t.encode()), digest.digest(after.encode()))
        assert 0 <= got[i]["near_edited"] <= 1
    assert digest.fingerprints(docs).count() == docs.count()
    one = digest.fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abca").hexdigest()


def brute_line_cuts(rows, min_words):
    """Lines covered by a run of enough words that occurs earlier."""
    docs = sorted({(r[0] is not None, r[0], r[1]) for r in rows if r[1] is not None}, key=lambda d: (d[0], d[1] or 0))
    seqs = [[(k, x, len(x.split())) for k, x in enumerate(t.split("\n")) if x.split()] for _, _, t in docs]
    seen, out = {}, {}
    for d, s in enumerate(seqs):
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                if sum(x[2] for x in s[a:b]) >= min_words:
                    key = tuple(x[1] for x in s[a:b])
                    if seen.setdefault(key, (d, a)) < (d, a):
                        out.setdefault(d, set()).update(s[k][0] for k in range(a, b))
    return {(docs[d][1], docs[d][2]): g for d, g in out.items()}


def test_line_dedup(spark, docs):
    rows = [r for r in ROWS if r[0] is not None]
    cuts = brute_line_cuts(rows, 50)
    got = line_dedup.cleaned(docs).collect()
    assert len(got) == len(ROWS) and cuts
    for r, src in [(r, t) for r in got for t in {q[1] for q in rows if q[0] == r["doc_id"]}]:
        gone = cuts.get((r["doc_id"], src), set())
        lines = (src or "").split("\n")
        full = sum(bool(x.split()) for x in lines)
        want = src if not gone else "" if len(gone) == full else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if r["doc_id"] != 4:                    # the null id with document 4's text comes first and keeps it
            assert (r["text"], r["__gone"]) == (want, len(gone))


def test_line_dedup_long_runs(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "_STEP", 3)
    run = [sentence(8) for _ in range(20)]
    rows = [(1, "\n".join(["p", *run, "q"])), (2, "\n".join(["r", *run[:13], "s", *run[13:]])), (3, "\n".join(run[5:] * 2))]
    cuts = brute_line_cuts([(i, t, 0) for i, t in rows], 50)
    got = line_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["__gone"] for r in got} == {i: len(cuts.get((i, t), ())) for i, t in rows}


def test_line_dedup_random_sequences(spark):
    # few different lines: long ambiguous prefixes, runs that overlap their copies
    rng = np.random.default_rng(5)
    lines = [sentence(8) for _ in range(3)]
    rows = [(i, "\n".join(lines[rng.integers(1 + i % 3)] for _ in range(rng.integers(1, 30)))) for i in range(24)]
    cuts = brute_line_cuts([(i, t, 0) for i, t in rows], 50)
    got = line_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: r["__gone"] for r in got} == {i: len(cuts.get((i, t), ())) for i, t in rows}


def test_sharding_law(spark, docs):
    rows = sharding.assign(sharding.document_nodes(docs), shards=4).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == docs.count() and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    assert len({r["shard"] for r in rows if r["doc_id"] in (0, 12)}) == 1        # equal texts


def test_sharding_cuts_a_group_beyond_the_quota(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(90)], "doc_id long, text string")
    counts = Counter(r["shard"] for r in sharding.assign(sharding.document_nodes(df), shards=7).collect())
    assert sorted(counts.values()) == [12, 13, 13, 13, 13, 13, 13]


def test_mixing_budget(spark, docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 3 for r in rows)
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(empty).count() == 0


def test_mixing_targets_are_shared_by_weight(spark):
    rows = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 90)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    # b stops at 30; 1170 over weights 1, 3 and 1: a 234, c 702, null 234
    assert got == {"a": 234.0, "b": 30.0, "c": 702.0, None: 234.0}


def test_language_id(spark, docs, empty):
    real = c.table(spark, SF, "documents")
    got = langid.language_id(real).toPandas().merge(real.toPandas()[["doc_id", "lang"]], on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95
    odd = spark.createDataFrame([(1, "123 !?", "en"), (2, None, "en"), (3, "", "de"), (4, "hello there", None)],
                                "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.language_id(odd).collect()} == {"und"}
    assert langid.language_id(empty).count() == 0


@pytest.mark.parametrize("op", [
    lambda d: packing.pack(d, tokenizer_path()), jaccard.near_duplicates, repetition.quality_rules, digest.fingerprints,
    line_dedup.dedup_lines, sharding.shard_documents, jaccard.keep_one, mixing.apply_mix])
def test_empty_tables(empty, op):
    assert op(empty).count() == 0


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline as P
    docs = c.table(spark, SF, "documents").where("doc_id < 60")
    for name, stage in P.STAGES[:-1]:
        before = docs.columns
        docs = c.materialize(stage(spark, docs, SF), name)
        assert docs.columns == before and docs.count() > 0
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    assert P.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
