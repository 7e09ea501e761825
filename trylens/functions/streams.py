"""Token lists of methods in Arrow batches.

The forms of ``folds`` for whole columns: a batch's tokens lie end to end, what
depends on a token alone is found once per different token of the batch, and
what depends on its neighbours is taken over the whole batch.  Only a row that
holds quote tokens is walked token by token.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .java import JAVA_RESERVED, PY_SPACES, QUOTES

# sent with the functions: the prediction chain runs on workers without this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STRINGS = T.ArrayType(T.StringType())
_RESERVED = frozenset(JAVA_RESERVED)
_PIECE = re.compile(r"\w+|[.]", re.ASCII)
_NO_WORD = re.compile(r"[^0-9A-Za-z_]")


class Lists:
    """A batch of token lists: the different tokens (``words``, null: None), each
    token's place among them (``code``), and the first token of every list."""

    def __init__(self, lists: pa.Array):
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        self.null = lists.is_null().to_numpy(zero_copy_only=False)
        self.texts = lists.flatten()
        self.sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))
        d = self.texts.dictionary_encode(null_encoding="encode")
        self.words = d.dictionary.to_pylist()
        self.code = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    @classmethod
    def of(cls, words: list, code: np.ndarray, sizes: np.ndarray, null: np.ndarray) -> Lists:
        """Lists whose tokens are coded already; ``words`` may hold a token twice."""
        x = cls.__new__(cls)
        x.words, x.code, x.sizes, x.null = words, code, sizes, null
        x.offsets = np.concatenate(([0], np.cumsum(sizes)))
        return x

    @classmethod
    def rows(cls, rows: list) -> Lists:
        """Lists of Python lists of tokens (or None)."""
        seen: dict[str, int] = {}
        code = np.array([seen.setdefault(w, len(seen)) for r in rows if r for w in r], dtype=np.int64)
        return cls.of(list(seen), code, np.array([len(r) if r else 0 for r in rows], dtype=np.int64),
                      np.array([r is None for r in rows], dtype=bool))

    def arrow(self) -> pa.ListArray:
        return list_array(pa.array(self.words, pa.string()).take(pa.array(self.code)), self.sizes, self.null)

    def flags(self, test) -> np.ndarray:
        """``test`` of every token."""
        return np.array([bool(w is not None and test(w)) for w in self.words] + [False])[:-1][self.code]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of each range, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def list_array(values: pa.Array, sizes: np.ndarray, null: np.ndarray | None = None) -> pa.ListArray:
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=None if null is None else pa.array(null))


def _depth(s: str) -> int:
    words = s.split()
    if '"' not in words and "'" not in words:
        return words.count("{") - words.count("}")
    quote, depth = "", 0
    for w in words:
        if w in QUOTES:
            quote = w if quote == "" else "" if quote == w else quote
        elif quote == "":
            depth += (w == "{") - (w == "}")
    return depth


@F.arrow_udf(T.IntegerType())
def depth_of_text(src: pa.Array) -> pa.Array:
    """``brace_depth`` of the words of a text; null for a null text."""
    return pa.array([None if s is None else _depth(s) for s in src.to_pylist()], pa.int32())


def _last_markers(x: Lists, markers: tuple[str, ...]) -> list[np.ndarray]:
    """Per marker the place of its last token outside quotes in each list, or -1."""
    row = np.repeat(np.arange(len(x.sizes)), x.sizes)
    quoted = np.zeros(len(x.sizes), dtype=bool)
    is_quote = x.flags(lambda w: w in QUOTES)
    quoted[row[is_quote]] = True
    out = []
    for marker in markers:
        last = np.full(len(x.sizes), -1, dtype=np.int64)
        at = np.flatnonzero(x.flags(lambda w: w == marker))
        last[row[at]] = at - x.offsets[row[at]]      # of equal rows the last one stays
        out.append(last)
    if quoted.any():
        event = is_quote | x.flags(lambda w: w in markers)
        for last in out:
            last[quoted] = -1
        quote, of = "", -1
        for i in np.flatnonzero(event & quoted[row]):
            if row[i] != of:
                quote, of = "", row[i]
            w = x.words[x.code[i]]
            if w in QUOTES:
                quote = w if quote == "" else "" if quote == w else quote
            elif quote == "":
                out[markers.index(w)][of] = i - x.offsets[of]
    return out


def _cuts(x: Lists) -> tuple[np.ndarray, ...]:
    """Per list the last TRY and CatchClause outside quotes, and the places where
    ``[:try]`` ends and ``[try:catch]`` ends by Python's rules."""
    ti, ci = _last_markers(x, ("TRY", "CatchClause"))
    place = lambda i: np.where(i < 0, np.maximum(x.sizes + i, 0), np.minimum(i, x.sizes))
    return ti, ci, place(ti), place(ci)


@F.arrow_udf(T.StructType([T.StructField("try_idx", T.IntegerType()), T.StructField("catch_idx", T.IntegerType()),
                           T.StructField("front", _STRINGS), T.StructField("back", _STRINGS)]))
def front_back(tokens: pa.Array) -> pa.Array:
    """The last TRY and CatchClause outside quotes and the lists they cut,
    ``tokens[:try]`` and ``tokens[try:catch]`` by Python's rules."""
    x = Lists(tokens)
    ti, ci, t, c = _cuts(x)

    def cut(start, stop):
        sizes = np.maximum(stop - start, 0)
        return list_array(x.texts.take(pa.array(ranges(x.offsets[:-1] + start, sizes))), sizes, x.null)
    return pa.StructArray.from_arrays(
        [pa.array(ti, pa.int32(), mask=x.null), pa.array(ci, pa.int32(), mask=x.null), cut(np.zeros_like(t), t), cut(t, c)],
        names=["try_idx", "catch_idx", "front", "back"])


def resplit(token: str) -> list[str]:
    """P9 of one token (see ``text.resplit_tokens``)."""
    return _PIECE.findall(token) if len(token) > 2 and _NO_WORD.search(token) else [token]


def _is_identifier(w: str) -> bool:
    return (w[:1] == "_" or (w[:1].isascii() and w[:1].isalpha())) and w not in _RESERVED


def _neighbour(x: Lists, flag: np.ndarray, step: int, outside: bool = False) -> np.ndarray:
    """``flag`` of the token ``step`` places on in the same list."""
    inside = np.arange(len(flag)) - np.repeat(x.offsets[:-1], x.sizes) + step
    ok = (inside >= 0) & (inside < np.repeat(x.sizes, x.sizes))
    return np.where(ok, np.roll(flag, -step), outside)


_KEYWORD, _STRING, _CALL, _QUALIFIER, _DOT, _DECLARED, _ASSIGNED, _PLAIN = range(8)


def marker_stream(keywords: dict[str, str], control: tuple[str, ...]):
    """The rules of ``structure.structural_token_stream`` as a function of ``Lists``."""
    made = {
        _KEYWORD: lambda w: [keywords[w]], _STRING: lambda w: [y for y in w.replace('"', "").split(" ") if y],
        _CALL: lambda w: ["METHOD", "INVOCATION", w, "arguments"], _QUALIFIER: lambda w: ["qualifier", w],
        _DOT: lambda w: [], _DECLARED: lambda w: ["VarDec", w], _ASSIGNED: lambda w: ["initializer"], _PLAIN: lambda w: [w]}

    def stream(x: Lists) -> Lists:
        ident = x.flags(_is_identifier)
        is_ = lambda *words: x.flags(lambda w: w in words)
        after = _neighbour(x, is_("{", "}", ";", "(", ",", "final"), -1, True)
        kind = np.select(
            [x.flags(lambda w: w in keywords), x.flags(lambda w: w.startswith('"')),
             ident & _neighbour(x, is_("("), 1) & ~is_(*control), ident & _neighbour(x, is_("."), 1), is_("."),
             ident & _neighbour(x, ident, 1) & after, is_("=") & _neighbour(x, ident, -1) & _neighbour(x, ident, -2)],
            [_KEYWORD, _STRING, _CALL, _QUALIFIER, _DOT, _DECLARED, _ASSIGNED], _PLAIN)
        # what a token becomes depends on the token and its kind
        keys, which = np.unique(x.code * 8 + kind, return_inverse=True)
        parts = [[p for y in made[int(k) % 8](x.words[int(k) // 8]) for p in resplit(y)] for k in keys]
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        size = sizes[which]
        total = np.concatenate(([0], np.cumsum(size)))
        return Lists.of([p for ps in parts for p in ps], ranges(starts[which], size), total[x.offsets[1:]] - total[x.offsets[:-1]], x.null)
    return stream


def stream_column(stream):
    """``marker_stream`` as a function of a column of token lists."""
    @F.arrow_udf(_STRINGS)
    def column(tokens: pa.Array) -> pa.Array:
        return stream(Lists(tokens)).arrow()
    return column


def _marker_words(src: pa.Array, tgt: pa.Array) -> Lists:
    def one(a, b):
        if a is None or b is None:
            return None
        return ["TRY" if w == "try" else w for w in a.split()] + ["CatchClause" if w == "catch" else w for w in b.split()]
    return Lists.rows([one(a, b) for a, b in zip(src.to_pylist(), tgt.to_pylist())])


@F.arrow_udf(_STRINGS)
def marker_words(src: pa.Array, tgt: pa.Array) -> pa.Array:
    """The words of ``src`` with ``try`` -> TRY and of ``tgt`` with ``catch`` ->
    CatchClause; null when either text is."""
    return _marker_words(src, tgt).arrow()


_CLOSING = re.compile(r"^(\}\s*)+", re.ASCII)
_FIRST_WORD = re.compile(r"\w+", re.ASCII)
_INNER, _FIRST, _LAST = range(3)


def _kind_of(rules):
    """``structure.line_kind`` of one line at its place in the method."""
    def test(kind, arg):
        if kind == "word":
            return lambda s, w: w in arg
        if kind == "word{":
            return lambda s, w: w in arg and s.endswith("{")
        if kind == "regex":
            find = re.compile(arg, re.ASCII).search
            return lambda s, w: find(s) is not None
        return lambda s, w: arg in s
    tests = [(test(kind, arg), tag) for kind, arg, tag in rules]

    def of(line: str, place: int) -> str:
        if place != _INNER:
            return "MethodDeclaration" if place == _FIRST else "MethodDeclaration END"
        s = _CLOSING.sub("", line.strip(), count=1).strip()
        w = _FIRST_WORD.match(s)
        w = w.group() if w else ""
        return next((tag for hit, tag in tests if hit(s, w)), "")
    return of


def renamed(line: str) -> str:
    """``text.rename_declared_variables`` of a stripped line."""
    t = line.strip()
    for run in ("    ", "   ", "  "):
        t = t.replace(run, " ")
    words = t.lstrip().split(" ")
    if len(words) > 2 and words[2] in ("=", ";"):
        words[1] = words[0][:1].lower() + words[0][1:]
        t = " ".join(words)
    return t


def renamed_words(line: str) -> list[str]:
    """The words of a line after ``text.rename_declared_variables``."""
    return renamed(line).split()


def line_corpus(rules, limit: int, pad_line: str):
    """Rows (id, split, lines, labels, src) in Arrow batches -> (id, split, lines_count,
    lines, labels): the rules of ``structure.method_is_balanced``, ``tag_lines`` and
    ``merge_statement_lines``, then stripping and renaming, cut or padded to ``limit``."""
    kind = _kind_of(rules)

    def groups(lines: list) -> tuple[list[int], list[str]]:
        """The first line of every group, and its first ``limit`` texts."""
        last = len(lines) - 1
        tags = [kind(ln, _LAST if i == last else _FIRST if i == 0 else _INNER) if ln is not None or i in (0, last) else ""
                for i, ln in enumerate(lines)]
        starts = [i for i, tag in enumerate(tags) if tag]
        own = starts[:limit]
        ends = [*starts[1:], len(lines)]
        return starts, [renamed("".join([x for x in lines[s:e] if x is not None]) + tags[s]) for s, e in zip(own, ends)]

    def run(batches):
        for b in batches:
            rows, counts, places, texts = [], [], [], []
            sizes = pc.fill_null(pc.list_value_length(b.column(3)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(np.maximum(sizes, 0))
            for i, (lines, src) in enumerate(zip(b.column(2).to_pylist(), b.column(4).to_pylist())):
                if not lines or src is None or _depth(src) != 0:
                    continue
                starts, own = groups(lines)
                if 0 <= sizes[i] <= starts[-1]:
                    raise ValueError(f"{sizes[i]} labels for a method whose line {starts[-1] + 1} begins a statement")
                more = limit - len(own)
                rows.append(i)
                counts.append(len(starts))
                texts += [*own, *[pad_line] * more]
                at = ends[i] - sizes[i]
                # -1: no label, the array is null; -2: padding
                places += [-1 if sizes[i] < 0 else at + s for s in starts[:limit]] + [-2] * more
            place = np.array(places, dtype=np.int64)
            labels = b.column(3).flatten()
            labels = pa.concat_arrays([labels, pa.array([0], labels.type)])
            place[place == -2] = len(labels) - 1
            own = labels.take(pa.array(place, mask=place == -1))
            fixed = np.full(len(rows), limit)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(counts, pa.int32()),
                 list_array(pa.array(texts, pa.string()), fixed), list_array(own, fixed)],
                names=["method_id", "split", "lines_count", "lines", "labels"])
    return run


def model_words(rules, context: bool):
    """The words of every line of a method as the line model reads it
    as a function of ``Lists`` of lines; ``context``: and those of the previous
    (``p:``) and next (``n:``) line.  A null line has null words and none for its
    neighbours."""
    kind = _kind_of(rules)

    def words(x: Lists) -> Lists:
        n = len(x.code)
        at = np.arange(n) - np.repeat(x.offsets[:-1], x.sizes)
        last = at == np.repeat(x.sizes, x.sizes) - 1
        # the words depend on the line and its place
        keys, which = np.unique(x.code * 3 + np.where(last, _LAST, np.where(at == 0, _FIRST, _INNER)), return_inverse=True)
        texts = [(x.words[k // 3], k % 3) for k in keys.tolist()]
        own = [[] if t is None else renamed_words(t + kind(t, place)) for t, place in texts]
        missing = np.array([t is None for t, _ in texts] + [False])[:-1][which]
        size = np.array([len(w) for w in own], dtype=np.int64)
        start = (np.cumsum(size) - size)[which]
        size = size[which]
        seen: dict[str, int] = {}
        code = np.array([seen.setdefault(w, len(seen)) for ws in own for w in ws], dtype=np.int64)
        pool = list(seen)
        if context:
            m, before, after = len(code), np.roll(np.arange(n), 1), np.roll(np.arange(n), -1)
            code = np.concatenate([code, code + len(pool), code + 2 * len(pool)])
            pool = [p + w for p in ("", "p:", "n:") for w in pool]
            start = np.stack([start, m + start[before], 2 * m + start[after]], axis=1)
            size = np.stack([size, np.where(at == 0, 0, size[before]), np.where(last, 0, size[after])], axis=1)
            size[missing] = 0
            return Lists.of(pool, code[ranges(start.ravel(), size.ravel())], size.sum(axis=1), missing)
        return Lists.of(pool, code[ranges(start, size)], size, missing)
    return words


def words_column(words):
    """``model_words`` as a function of a column of line arrays."""
    @F.arrow_udf(T.ArrayType(_STRINGS))
    def column(lines: pa.Array) -> pa.Array:
        x = Lists(lines)
        return list_array(words(x).arrow(), x.sizes, x.null)
    return column


# Readers: Arrow columns -> (row, place, Lists): token lists, the input row that each
# belongs to, and its place in that row (None: one list a row).

def read_lists(columns):
    """One column of token lists."""
    x = Lists(columns[0])
    return np.arange(len(x.sizes)), None, x


def read_lines(words):
    """One column of line arrays, each line's tokens by ``words``."""
    def read(columns):
        x = Lists(columns[0])
        row = np.repeat(np.arange(len(x.sizes)), x.sizes)
        return row, np.arange(len(row)) - x.offsets[row], words(x)
    return read


def _prefixed(x: Lists):
    """What TRY and CatchClause cut of each list, prefixed ``f:`` and ``b:``."""
    _, _, t, c = _cuts(x)
    size = np.stack([t, np.maximum(c - t, 0)], axis=1)
    start = np.stack([x.offsets[:-1], x.offsets[:-1] + t], axis=1)
    part = np.repeat(np.tile([0, len(x.words)], len(t)), size.ravel())
    code = x.code[ranges(start.ravel(), size.ravel())] + part
    pool = [None if w is None else p + w for p in ("f:", "b:") for w in x.words]
    return np.arange(len(t)), None, Lists.of(pool, code, size.sum(axis=1), x.null)


def read_front_back(columns):
    """Two columns, source and target: the front and back words of their markers
    (``front_back`` of ``marker_words``), prefixed."""
    return _prefixed(_marker_words(*columns))


_AROUND = re.compile(f"[{PY_SPACES}]*([().])[{PY_SPACES}]*")


def read_method_text(stream, token: str):
    """One column of method texts: the front and back tokens of the marker stream of
    a text that lacks up to two braces, of the words of any other (the rules of
    ``structure.repair_unclosed_method``), prefixed."""
    tokens = re.compile(token, re.ASCII).findall

    def read(columns):
        good, other = [], []
        for s in columns[0].to_pylist():
            d = None if s is None else _depth(s)
            ok = d is not None and 0 <= d <= 2
            good.append(tokens(s + " }" * d) if ok else [])
            other.append([] if ok else None if s is None else (
                _AROUND.sub(r"\1", s).replace("\r", " ").replace("\t", " ") + " } } }").split())
        x = stream(Lists.rows(good))
        if any(r != [] for r in other):
            y = Lists.rows(other)
            size = np.stack([x.sizes, y.sizes], axis=1)
            start = np.stack([x.offsets[:-1], len(x.code) + y.offsets[:-1]], axis=1)
            code = np.concatenate([x.code, y.code + len(x.words)])
            x = Lists.of(x.words + y.words, code[ranges(start.ravel(), size.ravel())], size.sum(axis=1), y.null)
        return _prefixed(x)
    return read


_ITEMS = 1 << 16        # lines that are read together


def _pieces(batches):
    """The batches in runs of rows with about ``_ITEMS`` elements in the second
    column, if that holds lists."""
    for b in batches:
        if not pa.types.is_list(b.column(1).type) or not b.num_rows:
            yield b
            continue
        ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _ITEMS, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def _labels_at(labels: pa.Array, texts: pa.Array, row: np.ndarray, place: np.ndarray):
    """Labels of lines by their place (``arrays_zip``: null beyond the shorter array,
    nothing when either array is null): (lines that count, all labels; first those
    of these lines)."""
    sizes = pc.fill_null(pc.list_value_length(labels), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.cumsum(sizes) - sizes
    counts = labels.is_valid().to_numpy(zero_copy_only=False)[row]
    row, place = row[counts], place[counts]
    own = pa.array(offsets[row] + place, mask=place >= sizes[row])
    n_lines = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    more = np.where(texts.is_valid().to_numpy(zero_copy_only=False), np.maximum(sizes - n_lines, 0), 0)
    rest = pa.array(ranges(offsets + n_lines, more), pa.int64())
    return counts, labels.flatten().take(pa.concat_arrays([own.cast(pa.int64()), rest]))


def token_counts(read):
    """Rows (class or list of classes, what ``read`` takes) in Arrow batches ->
    (class_id, doc, token, n): per piece of a batch how often each class has each
    token, and how many token lists (``doc``) it has."""
    def run(batches):
        for b in _pieces(batches):
            row, place, x = read(b.columns[1:])
            labels, sizes, code = b.column(0), x.sizes, x.code
            if place is not None:
                counts, labels = _labels_at(labels, b.column(1), row, place)
                if not counts.all():
                    code, sizes = code[np.repeat(counts, sizes)], sizes[counts]
            names = labels.dictionary_encode(null_encoding="encode")
            of = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            k = max(len(names.dictionary), 1)
            docs = np.bincount(of, minlength=k)[:len(names.dictionary)]
            pair = code * k + np.repeat(of[:len(sizes)], sizes)
            if len(x.words) * k <= 8 * len(pair):
                every = np.bincount(pair)
                pair = np.flatnonzero(every)
                n = every[pair]
            else:
                pair, n = np.unique(pair, return_counts=True)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([names.dictionary, names.dictionary.take(pa.array(pair % k))]),
                pa.array(np.arange(len(docs) + len(pair)) < len(docs)),
                pa.array([None] * len(docs) + [x.words[i] for i in (pair // k).tolist()], pa.string()),
                pa.array(np.concatenate([docs, n]).astype(np.int64))], names=["class_id", "doc", "token", "n"])
    return run


def head_sums(shared, classes: int, read):
    """Rows (key, what ``read`` takes) in Arrow batches -> per token list (key, place
    from 1 on or null, n_known, s0.., rare): the number of tokens found in the table
    ``shared`` (tokens, weights of each class), the sums of their weights, and the
    tokens not found in it."""
    def run(batches):
        tokens, weights = shared.value
        known = {t: i for i, t in enumerate(tokens)}
        for b in _pieces(batches):
            row, place, x = read(b.columns[1:])
            n = len(x.sizes)
            at = np.array([-2 if w is None else known.get(w, -1) for w in x.words] + [-2], dtype=np.int64)[:-1][x.code]
            of = np.repeat(np.arange(n), x.sizes)
            own, found = of[at >= 0], at[at >= 0]
            rare = np.flatnonzero(at == -1)
            yield pa.RecordBatch.from_arrays([
                b.column(0) if place is None else b.column(0).take(pa.array(row)),
                pa.nulls(n, pa.int32()) if place is None else pa.array(place + 1, pa.int32()),
                pa.array(np.bincount(own, minlength=n).astype(np.int64)),
                *[pa.array(np.bincount(own, weights=w[found], minlength=n).astype(np.float64)) for w in weights[:classes]],
                list_array(pa.array([x.words[i] for i in x.code[rare].tolist()], pa.string()), np.bincount(of[rare], minlength=n))],
                names=["key", "place", "n_known", *[f"s{k}" for k in range(classes)], "rare"])
    return run
