"""Tokens of real (unspaced) Java source as column expressions.

One ``regexp_extract_all`` pass cuts a text into comments, literals, names,
numbers, operators, separators and white space.  Every character belongs to a
token, so offsets and line numbers are running sums over the pieces, taken over
a whole Arrow batch at once.  Code
tokens are the pieces that are neither white space nor comments; a string,
character or text block is one token, so nothing inside it can be mistaken for
code.  The token folds of ``folds`` (depth, markers, statements) work on code
tokens as they do on a white-space split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .java import QUOTES

# --- fixed values: the lexical grammar of Java ------------------------------
# Possessive loops: a long literal or comment is matched without recursion.
_BRANCHES = (
    r"\s++",
    r"//[^\r\n]*+",
    r"/\*(?:(?s:.*?)\*/|(?s:.*+))",                     # unclosed: to the end
    r'"""(?:[^"\\]++|\\(?s:.)|"(?!""))*+(?:""")?+',
    r'"(?:[^"\\\r\n]++|\\.)*+"?+',                      # unclosed: to the line's end
    r"'(?:[^'\\\r\n]++|\\.)*+'?+",
    r"[\p{L}_$][\p{L}\p{Nd}_$]*+",
    r"0[xX][0-9a-fA-F_.]*+(?:[pP][+-]?+[0-9_]++)?+[lLfFdD]?+",
    r"(?:[0-9][0-9_]*+(?:\.[0-9][0-9_]*+|\.(?![.\p{L}_$]))?+|\.[0-9][0-9_]*+)(?:[eE][+-]?+[0-9_]++|[bB][01_]++)?+[lLfFdD]?+",
    r">>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<",
    r"(?s:.)",
)
JAVA_TOKEN = "|".join(_BRANCHES)
_BLANKS = (9, 10, 11, 12, 13, 32)
# ----------------------------------------------------------------------------

_KINDS = ("name", "space", "comment", "text", "string", "char", "number", "op")
_NAME, _SPACE, _COMMENT, _TEXT, _STRING, _CHAR, _NUMBER, _OP = range(len(_KINDS))
_PIECE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()),
                       T.StructField("at", T.IntegerType()), T.StructField("line", T.IntegerType())])


def pieces(src: Column) -> Column:
    """array<string>: the pieces of ``src``, which tile it; none for a null text."""
    return F.coalesce(F.regexp_extract_all(src, F.lit(JAVA_TOKEN), 0), F.array().cast("array<string>"))


def _newlines(t: Column) -> Column:
    # not translate: it takes every character through a hash table
    return F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))


def is_code(t: Column) -> Column:
    """A piece that begins with white space is white space."""
    return ~F.ascii(t).isin(*_BLANKS) & ~t.startswith("//") & ~t.startswith("/*")


class Spread:
    """The pieces of a batch of texts (``lists``), end to end: ``texts``, the first
    piece of every text in ``offsets``, and per piece its place and kind.  What
    depends on a piece alone is found once per different piece (``words``, ``code``)."""

    def __init__(self, lists: pa.ListArray, letters: frozenset = frozenset()):
        self.texts = lists.flatten()
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(counts)))
        self._counts = counts
        d = self.texts.dictionary_encode()
        self.words, self.code = d.dictionary, d.indices.to_numpy(zero_copy_only=False)
        self.at = self._before(pc.utf8_length(self.words))
        self.line = self._before(pc.count_substring(self.words, "\n")) + 1
        self.kind = _kinds(self.words, letters)[self.code]

    def _before(self, sizes: pa.Array) -> np.ndarray:
        """The sum of ``sizes``, given per word, over the pieces before each one of its text."""
        total = np.concatenate(([0], np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)[self.code])))
        return total[:-1] - np.repeat(total[self.offsets[:-1]], self._counts)


def _kinds(texts: pa.Array, letters: frozenset) -> np.ndarray:
    """The place in ``_KINDS`` of each piece, by its first characters; ``letters``
    are the letters beyond ASCII."""
    def by_first(c):
        if c in letters or c in "_$" or (c.isascii() and c.isalpha()):
            return _NAME
        if ord(c) in _BLANKS:
            return _SPACE
        return {'"': _STRING, "'": _CHAR}.get(c, _NUMBER if "0" <= c <= "9" else _OP)
    first = pc.utf8_slice_codeunits(texts, 0, 1).dictionary_encode()
    kinds = np.array([by_first(c) for c in first.dictionary.to_pylist()], dtype=np.int8)
    out = kinds[first.indices.to_numpy(zero_copy_only=False)]
    for kind, pattern in ((_COMMENT, r"^/[/*]"), (_TEXT, '^"""'), (_NUMBER, r"^\.[0-9]")):
        out[pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)] = kind
    return out


@F.arrow_udf(T.ArrayType(_PIECE))
def _lexed(p: pa.Array, letters: pa.Array) -> pa.Array:
    x = Spread(p, frozenset(letters.flatten().to_pylist()))
    kind = pa.array(_KINDS).take(pa.array(x.kind))
    rows = pa.StructArray.from_arrays([kind, x.texts, pa.array(x.at, pa.int32()), pa.array(x.line, pa.int32())],
                                      names=["kind", "text", "at", "line"])
    return pa.ListArray.from_arrays(pa.array(x.offsets, pa.int32()), rows)


def lex(src: Column) -> Column:
    """array<struct<kind, text, at, line>>: all pieces of ``src`` in order.

    ``at`` is the 0-based character offset, ``line`` the 1-based line of the
    piece's first character; a null text has no pieces."""
    # which characters are letters is for the engine of the token pattern to say
    return _lexed(pieces(src), F.regexp_extract_all(src, F.lit(r"[\p{L}&&[^\x00-\x7F]]"), 0))


def code_words(src: Column) -> Column:
    """array<string>: the texts of the code tokens, for the token folds."""
    return F.filter(pieces(src), is_code)


@F.arrow_udf(T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType()))]))
def code_of_pieces(p: pa.Array) -> pa.Array:
    """struct(depth, words): the code tokens among the pieces and their ``folds.brace_depth``."""
    x = Spread(p)
    code = (x.kind != _SPACE) & (x.kind != _COMMENT)
    value = np.array([{"{": 1, "}": -1}.get(w, 0) for w in x.words.to_pylist()] + [0])[:-1][x.code] * code
    total = np.concatenate(([0], np.cumsum(value)))
    out = total[x.offsets[1:]] - total[x.offsets[:-1]]
    quotes = pc.is_in(x.words, pa.array(QUOTES)).to_numpy(zero_copy_only=False)
    if quotes.any():
        for row in np.unique(np.searchsorted(x.offsets, np.flatnonzero(quotes[x.code]), side="right") - 1):
            own = slice(x.offsets[row], x.offsets[row + 1])
            quote, depth = "", 0
            for w in x.texts[own].filter(pa.array(code[own])).to_pylist():
                if w in QUOTES:
                    quote = w if quote == "" else "" if quote == w else quote
                elif quote == "":
                    depth += (w == "{") - (w == "}")
            out[row] = depth
    counts = np.concatenate(([0], np.cumsum(code)))[x.offsets]
    words = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), x.texts.filter(pa.array(code)))
    return pa.StructArray.from_arrays([pa.array(out, pa.int32()), words], names=["depth", "words"])
