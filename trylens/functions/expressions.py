"""A4 with expression markers: operator precedence in one walk over code tokens.

Rows are walked in Arrow batches: as a native fold the walk took some twenty
times as long.  The walk keeps a stack of pending binary operators with the place where their
left operand begins.  A new operator takes over the operands of all pending
ones that bind at least as tightly, so its ``BinaryOperation`` marker belongs
where the first of them begins, and ``operandr`` stands before its right
operand.  Brackets open a level of their own.  Every token gives items (place,
order, text); sorted by place they are the stream.

Rules (ours): ``Assignment x = value e``; ``VarDec Type name initializer e`` for
every type, basic ones included; ``BinaryOperation l op operandr r`` by Java's
precedence, from left to right; ``TernaryExpression c ? a : b``; ``METHOD
INVOCATION [qualifier q] name arguments ( ... )``; ``ClassCreator Type arguments
( ... )``; ``MethodDeclaration Type name parameters ( ... )``; ``CatchClause
parameter ( ... )``; a dotted name in an expression is ``qualifier a . b c``, the
dots of a type stay; ``TRY``, ``RETURN``, ``ELSE`` and ``throws``; literals lose
their double quotes and are split on spaces; all other tokens stay.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .streams import Lists, list_array, resplit
from .streams import _is_identifier as is_identifier
from .tree import ASSIGNMENTS, BASIC_TYPES, CONTROL, statement_kind, walk

# --- fixed values -----------------------------------------------------------
# Binary operators of Java, loosest first.
PRECEDENCE = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">=", "instanceof"), ("<<",),
              ("+", "-"), ("*", "/", "%"))
WORDS = {"try": "TRY", "catch": "CatchClause", "return": "RETURN", "else": "ELSE", "new": "ClassCreator"}
MODIFIERS = ("public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "default")
SELF = ("this", "super")
OPEN, CLOSE = ("(", "[", "{"), (")", "]", "}")
# order of items at one place: markers, the token, what follows it
_STATEMENT, _TERNARY, _BINARY, _CALL, _TOKEN, _AFTER = 0, 10, 20, 30, 40, 100
# ----------------------------------------------------------------------------

_BRACE, _PAREN = -2, -1                           # a bracket among the operators
# markers of the statement tree
_TREE = {"LocalVariableDeclaration": "VarDec", "method": "MethodDeclaration", "class": "ClassDeclaration",
         "interface": "InterfaceDeclaration", "enum": "EnumDeclaration", "record": "RecordDeclaration"}


_MARKED = frozenset(("scope", "member", "statement"))
_OPERATORS = {o: p + 1 for p, group in enumerate(PRECEDENCE) for o in group}
_ENDS = frozenset((";", ",", ":", "->", "return", "throw", "case", "else", "do"))
_IN_GENERIC = frozenset((",", "?", "&", "[", "]", ".", "extends", "super"))
_ASSIGN, _BASIC, _CONTROL = frozenset(ASSIGNMENTS), frozenset(BASIC_TYPES), frozenset(CONTROL)
_BEFORE_GENERIC = frozenset(("?", ">", *BASIC_TYPES))
_TYPE_END = frozenset((">", "]", *BASIC_TYPES))
_DECLARING = frozenset((">", "]", "void", *BASIC_TYPES))
_OPERAND_END = frozenset((")", "]", "++", "--", *SELF))
_NOT_DOTTED = frozenset((".", "<", "[", "..."))
_LITERAL = frozenset("0123456789\"'.")
_OPENING, _CLOSING = frozenset(OPEN), frozenset(CLOSE)
_BLANKS = re.compile(r"\s+", re.ASCII)
_CONSTANT = re.compile(r"^[A-Z0-9_$]{2,}$")


def marker_stream(t: Column) -> Column:
    """array<string>: the marker stream of the code tokens ``t``, longer tokens
    cut into words and dots (P9)."""
    return _streams(t)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _streams(tokens: pa.Array) -> pa.Array:
    x = Lists(tokens)
    is_id = [w is not None and is_identifier(w) for w in x.words]
    given, words = x.words, ["" if w is None else w for w in x.words]
    parts: dict[str, list[str]] = {}             # P9 of a marker or token
    out: list[str] = []
    sizes = []
    offsets, code = x.offsets.tolist(), x.code.tolist()
    for lo, hi in zip(offsets[:-1], offsets[1:]):
        own = code[lo:hi]
        before = len(out)
        items = _marks([given[c] for c in own])
        _items([words[c] for c in own], [is_id[c] for c in own], items)
        items.sort()
        for _, _, text in items:
            p = parts.get(text)
            if p is None:
                p = parts[text] = resplit(text)
            out += p
        sizes.append(len(out) - before)
    return list_array(pa.array(out, pa.string()), np.array(sizes, dtype=np.int64))


def _marks(t: list) -> list[tuple]:
    """The items of the statement tree."""
    out = []
    for role, kind, start, *_ in walk(t, None, _MARKED):
        if kind is None and statement_kind(t, start) == "LocalVariableDeclaration":
            kind = "LocalVariableDeclaration"
        if kind in _TREE:
            out.append((start, _STATEMENT, _TREE[kind]))
    return out


def _literal(c: str, i: int) -> list[tuple]:
    pieces = [x for x in _BLANKS.split(c.replace('"', "")) if x]
    return [(i, _TOKEN + min(j, 59), x) for j, x in enumerate(pieces)]


def _items(t: list[str], ids: list[bool], items: list[tuple]) -> None:
    """Adds the items (place, order, text) of all tokens, unsorted."""
    n = len(t)
    # what lies outside is empty: behind the end, and by negative places before it
    t = [*t, "", "", ""]
    ids = [*ids, False, False, False]
    ops: list[tuple[int, int, int]] = []         # (precedence, left operand's place, place of a bracket)
    start, chain, generic = 0, -1, 0
    add = items.append
    for i in range(n):
        c, prev, nxt = t[i], t[i - 1], t[i + 1]
        if ids[i]:
            if not (prev == "." and chain >= 0 and (ids[i - 2] or t[i - 2] in SELF)):
                chain = i
            add((i, _TOKEN, c))
            # calls, declarations and dotted names that end with this name
            call = nxt == "("
            if call or chain < i:
                b = t[chain - 1]
                if call and b != "@":
                    typed = ids[chain - 1] or b in _DECLARING or (chain == i and b in MODIFIERS)
                    made = b == "new"
                    if not typed and not made:
                        add((chain, _CALL, "METHOD"))
                        add((chain, _CALL + 1, "INVOCATION"))
                    add((i, _AFTER, "arguments" if made or not typed else "parameters"))
                if chain < i and nxt not in _NOT_DOTTED and not ids[i + 1] and b != "new" and b != "@":
                    add((chain, _CALL + 2, "qualifier"))
            continue
        # markers of the token itself: a word's, a literal's pieces, nothing for a dropped dot
        dot = c == "."
        if dot and chain >= 0 and ids[i + 1] and not ids[i + 2] and t[i + 2] not in (".", "<", "[") and t[chain - 1] != "new":
            own = []
        elif c.startswith('"'):
            own = _literal(c, i)
        else:
            own = [(i, _TOKEN, WORDS.get(c, c))]
        then = i if c in SELF else chain if dot and chain >= 0 else -1
        if c == "<" and ids[i + 1] | (nxt in _BEFORE_GENERIC) and (
                prev == "." or (ids[i - 1] and "A" <= prev[0] <= "Z" and not _CONSTANT.match(prev))):
            chain, generic = -1, generic + 1
            items += own
            continue
        if generic > 0:
            if c == ">":
                chain, generic = -1, generic - 1
                items += own
                continue
            if c in _IN_GENERIC:
                chain = then
                items += own
                continue
        if c in _OPENING:
            if c == "(" and prev == "catch":
                add((i - 1, _AFTER, "parameter"))
            items += own
            ops.append((_BRACE if c == "{" else _PAREN, start, i))
            start, chain, generic = i + 1, -1, 0
            continue
        left = len(ops)                          # brackets and what stands around the innermost one
        while left and ops[left - 1][0] >= 0:
            left -= 1
        if c in _CLOSING:
            mine = ops[left - 1] if left else None
            # a condition is no operand: what follows it begins anew
            fresh = c == "}" or mine is None or t[mine[2] - 1] in _CONTROL
            start = i + 1 if fresh else mine[1]
            del ops[max(left - 1, 0):]
            chain, generic = -1, 0
            items += own
            continue
        begin = ops[left][1] if left < len(ops) else start     # of the whole level
        if c in _ENDS:
            items += own
        elif c in _ASSIGN:
            first = False
            if c == "=":
                # Type name =, or the next name of a declaration, brackets behind it or not
                j = i - 3 if prev == "]" and t[i - 2] == "[" else i - 1
                first = j >= 0 and ids[j] and (ids[j - 1] or t[j - 1] in _TYPE_END
                                               or (t[j - 1] == "," and (not left or ops[left - 1][0] == _BRACE)))
            if first:
                add((i, _TOKEN, "initializer"))
            else:
                items += ((begin, _STATEMENT + 5, "Assignment"), (i, _TOKEN, c), (i, _AFTER, "value"))
        elif c == "?":
            items += ((begin, _TERNARY, "TernaryExpression"), (i, _TOKEN, c))
        else:
            # the lexer gives closing angles one by one
            prec = (8 if prev == ">" else 0 if nxt == ">" else _OPERATORS[c]) if c == ">" else _OPERATORS.get(c, 0)
            sign = prec > 0 and c in "+-" and (
                not (ids[i - 1] or prev in _OPERAND_END or (prev != "" and prev[0] in _LITERAL and "." not in prev[1:]))
                or (prev == ")" and t[i - 2] in _BASIC and t[i - 3] == "("))                  # behind a cast
            if prec == 0 or sign:
                chain = then
                items += own
                continue
            first = len(ops)                     # those below it stay pending
            while first and ops[first - 1][0] >= prec:
                first -= 1
            where = ops[first][1] if first < len(ops) else start
            items += ((where, _BINARY, "BinaryOperation"), (i, _TOKEN, c), (i, _AFTER, "operandr"))
            ops[first:] = [(prec, where, -1)]
            start, chain = i + 1, -1
            continue
        del ops[left:]
        start, chain = i + 1, -1
        if c == ";":
            generic = 0
