"""Statement and scope tree of Java code tokens, by one stack walk a row.

``walk`` goes through the brackets, semicolons and labels of a token list with a
stack of open brackets, in Arrow batches: as a native fold it took some
ten times as long.  Each brace gets a kind from the tokens before it (type,
method, control block, initialiser, lambda ...), each statement ends at the
semicolon or brace of its own level, and what is not code (array initialisers,
lambda and anonymous bodies inside an expression) does not end the statement
around it.  The rules are ours; no parser is involved and invalid code still
gives a tree.
"""

from __future__ import annotations

import re
from operator import itemgetter
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .java import JAVA_RESERVED
from .lexer import _COMMENT, _SPACE, Spread, pieces

# --- fixed values: node kinds by the first word of a statement ---------------
STATEMENT_KINDS = {
    "if": "IfStatement", "for": "ForStatement", "while": "WhileStatement", "do": "DoStatement",
    "try": "TryStatement", "switch": "SwitchStatement", "return": "ReturnStatement", "throw": "ThrowStatement",
    "break": "BreakStatement", "continue": "ContinueStatement", "synchronized": "SynchronizedStatement",
    "assert": "AssertStatement",
}
CONTROL = ("if", "for", "while", "switch", "catch", "synchronized", "try")
BLOCK_WORDS = ("else", "do", "try", "finally")
TYPE_WORDS = ("class", "interface", "enum")
ASSIGNMENTS = ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=")
BASIC_TYPES = ("boolean", "byte", "char", "double", "float", "int", "long", "short")
EVENTS = ("(", ")", "{", "}", ";", ":", "->", "else", "do")
# a declaration: [final] Type name, then what may follow a declared name
_NAME = r"[\p{L}_$][\p{L}\p{N}_$]*"
DECLARATION = (rf"^((final|@ {_NAME}) )*{_NAME}( \. {_NAME})*( <[^=;()]*>)?( \[ \])* {_NAME}( \[ \])* (=|;|,|:)")
# ----------------------------------------------------------------------------

_WINDOW = 64        # tokens read to name the kind of an expression statement
_NODE = T.StructType([T.StructField(n, T.StringType() if n in ("role", "kind", "parent_kind") else T.IntegerType())
                      for n in ("role", "kind", "start", "open", "end", "level", "parent", "parent_kind")])
_PARSED = T.StructType([T.StructField("t", T.ArrayType(T.StringType())), T.StructField("at", T.ArrayType(T.IntegerType())),
                        T.StructField("line", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(_NODE))])
_NOT_SUB = ("{", ";", "")       # after these no statement without braces begins


_BASIC, _ASSIGN = frozenset(BASIC_TYPES), frozenset(ASSIGNMENTS)
_NO_TYPE = frozenset(w for w in JAVA_RESERVED if w not in _BASIC and w != "final")
_IS_DECLARATION = re.compile(DECLARATION.replace(r"\p{L}\p{N}", "A-Za-z0-9").replace(r"\p{L}", "A-Za-z")).match


def _plain(c: str) -> str:
    """An ASCII character of the class of ``c``, none of ``final``."""
    return c if c.isascii() else {"L": "z", "N": "0"}.get(category(c)[0], "!")


def statement_kind(t: list[str], start: int) -> str:
    """The kind of the statement that begins at token ``start`` of ``t``."""
    own = t[start:start + _WINDOW]
    word = own[0] if own else ""
    if word in STATEMENT_KINDS:
        return STATEMENT_KINDS[word]
    if ";" in own:
        own = own[:own.index(";") + 1]
    if word not in _NO_TYPE:
        text = " ".join([w for w in own if w is not None])
        if _IS_DECLARATION(text if text.isascii() else "".join(map(_plain, text))):
            return "LocalVariableDeclaration"
    if not _ASSIGN.isdisjoint(own):
        before = own[:next(i for i, w in enumerate(own) if w in _ASSIGN)]
        if before.count("(") == before.count(")"):
            return "Assignment"
    return "MethodInvocation" if "(" in own else "StatementExpression"


# An open bracket: its place, the head of the statement around it, where its node
# starts, its kind, and what stands inside (mode).
Frame = tuple[int, int, int, str, str]
_OPEN, _HEAD, _START, _FRAME_KIND, _MODE = range(5)
_MODES = {**dict.fromkeys(("class", "interface", "record", "anonymous", "constant"), "type"), "enum": "enum", "init": "init"}
_INNER = ("init", "lambda", "anonymous")
# A node: role, kind, start, open, end, level, parent, parent_kind (see ``nodes``).
ROLES = frozenset(("scope", "statement", "member", "case", "sub"))


def _brace_kind(t: list[str], i: int, head: int, paren: int, before: str, mode: str) -> tuple[str, int]:
    """(kind, start): what the brace at ``i`` opens, from the tokens before it.

    ``head`` begins its statement, ``paren`` is the parenthesis closed last."""
    at = lambda j: t[j] if j >= 0 else ""
    name = paren - 1
    if before in ("=", "]", "(", ",", "default") or (before == "{" and mode == "init"):
        return "init", i
    if before == "->" and head < i:
        return "lambda", i
    own = t[head:i]
    if "class" in own or "interface" in own or "enum" in own:
        typed = next((j for j in range(head, i) if t[j] in TYPE_WORDS and at(j - 1) != "."), None)
        if typed is not None:
            return t[typed], head
    first = head + (t[head] == ",")              # behind the comma of the constant before
    if before == ")":
        if at(name) in CONTROL:
            return at(name), name
        if at(name - 1) == "record":
            return "record", head
        new = next((j for j in range(name, head - 1, -1) if t[j] == "new"), None)
        if new is not None and not any(w in ("(", ")", "=", "{", ";") for w in t[new:name + 1]):
            return "anonymous", new
        return {"enum": ("constant", first), "type": ("method", head)}.get(mode, ("block", i))
    if before in BLOCK_WORDS:
        return before, i - 1
    if mode == "type" and "throws" in own:
        return "method", head
    if mode == "enum" and head < i:
        return "constant", first
    return ("initializer", head) if mode == "type" else ("block", i)


def walk(t: list[str], events: list[int] | None = None, roles: frozenset = ROLES) -> list[tuple]:
    """The nodes of one token list that have one of ``roles``; statements that their
    tokens name have no kind yet.  ``events``: the places of ``EVENTS``, if known."""
    n = len(t)
    at = lambda j: t[j] if 0 <= j < n else ""
    if events is None:
        events = [i for i, c in enumerate(t) if c in EVENTS]
    stack: list[Frame] = []
    scopes: list[Frame] = []                     # the braces of the stack
    out: list[tuple] = []
    head, paren = 0, -1

    def add(role, kind, start, opened, end):
        if role in roles:
            f = scopes[-1] if scopes else (-1, 0, 0, "")
            out.append((role, kind, start, opened, end, len(scopes), f[_OPEN], f[_FRAME_KIND]))

    for i in events:
        c = t[i]
        nxt = t[i + 1] if i + 1 < n else ""
        if c == "(":
            stack.append((i, head, i, "paren", "paren"))
            head = i + 1
            continue
        top = stack[-1] if stack else None
        mode = top[_MODE] if top else None
        if c == ")":
            if mode == "paren":
                stack.pop()
                head, paren = top[_HEAD], top[_OPEN]
                if nxt not in _NOT_SUB and stack and stack[-1][_MODE] == "code" and at(paren - 1) in ("if", "for", "while"):
                    add("sub", None, i + 1, None, None)
        elif c == "{":
            kind, start = _brace_kind(t, i, head, paren, at(i - 1), mode or "type")
            f = (i, head, start, kind, _MODES.get(kind, "code"))
            stack.append(f)
            scopes.append(f)
            head = i + 1
        elif c == "}":
            # parentheses still open inside the brace go with it
            while stack and stack[-1][_MODE] == "paren":
                stack.pop()
            if not stack:
                head = i + 1
                continue
            f = stack.pop()
            scopes.pop()
            kind, first = f[_FRAME_KIND], f[_HEAD]
            add("scope", kind, f[_START], f[_OPEN], i)
            inner = kind in _INNER
            more = nxt == "else" or (nxt == "while" and at(first) == "do") or (f[_MODE] == "code" and nxt in ("catch", "finally"))
            if not inner and not more and stack and stack[-1][_MODE] == "code":
                named = "TypeDeclaration" if kind in (*TYPE_WORDS, "record") else "BlockStatement" if kind == "block" else None
                add("statement", named, first, f[_OPEN], i)
            # what stands in parentheses or goes on keeps its head
            head = first if inner or more else i + 1
        elif mode == "paren":
            continue
        elif c == ";":
            if nxt == "else" or (nxt == "while" and at(head) == "do"):
                continue
            if mode == "enum":                   # an enum's constants end here; the rest of it is a class body
                stack[-1] = scopes[-1] = (*top[:_MODE], "type")
            elif head < i and mode == "code":
                add("statement", None, head, None, i)
            elif head < i:
                abstract = paren > head and mode == "type" and "=" not in t[head:i]
                add("member", "method" if abstract else "field", head, None, i)
            head = i + 1
        elif c in (":", "->"):
            first = at(head)
            if first == "case" or (first == "default" and head == i - 1):
                add("case", "SwitchStatementCase", head, None, i)
                head = i + 1
            elif c == ":" and head == i - 1 and first != "default" and mode == "code":
                head = i + 1
        elif nxt not in _NOT_SUB:                # else, do
            add("sub", None, i + 1, None, None)

    left, scopes = scopes, []
    for f in left:
        kind = f[_FRAME_KIND]
        add("scope", kind, f[_START], f[_OPEN], None)
        if scopes and scopes[-1][_MODE] == "code" and kind not in _INNER:
            add("statement", None, f[_HEAD], f[_OPEN], None)
        scopes.append(f)
    return sorted(out, key=itemgetter(2, 5))


class Sources:
    """The code tokens of a batch of texts, given as the pieces of each: per token
    its place (``at``), its line and its piece; ``rows`` gives each text's tokens and
    the places of those that the walk stops at."""

    def __init__(self, p: pa.ListArray):
        self.x = x = Spread(p)
        self.piece = np.flatnonzero((x.kind != _SPACE) & (x.kind != _COMMENT))
        self.offsets = np.searchsorted(self.piece, x.offsets)
        self.at, self.line = x.at[self.piece], x.line[self.piece]
        self.code = x.code[self.piece]

    def rows(self):
        words = self.x.words.to_pylist()
        stops = np.flatnonzero(np.array([w in _STOPS for w in words] + [False])[:-1][self.code])
        first = np.searchsorted(stops, self.offsets).tolist()
        offsets, code, stops = self.offsets.tolist(), self.code.tolist(), stops.tolist()
        for k, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:])):
            yield lo, [words[c] for c in code[lo:hi]], [i - lo for i in stops[first[k]:first[k + 1]]]

    def texts(self, first: list[int], last: list[int]) -> pa.StringArray:
        """What stands from token ``first`` to token ``last``, as written."""
        t = self.x.texts
        if not first:
            return pa.array([], pa.string())
        ends = np.frombuffer(t.buffers()[1], dtype=np.int32)[t.offset:t.offset + len(t) + 1]
        data = memoryview(t.buffers()[2])
        a, z = ends[self.piece[first]].tolist(), ends[self.piece[last] + 1].tolist()
        sizes = np.array(z, dtype=np.int64) - np.array(a, dtype=np.int64)
        if sizes.sum() > (1 << 31) - 1:
            raise ValueError("the nested texts of a batch exceed 2 GB: lower spark.sql.execution.arrow.maxRecordsPerBatch")
        joined = b"".join([data[i:j] for i, j in zip(a, z)])
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        return pa.StringArray.from_buffers(len(a), pa.py_buffer(offsets), pa.py_buffer(joined))

    def spans(self, first: list[int], last: list[int]) -> list[pa.Array]:
        """Start line, end line and text of each range of tokens."""
        return [pa.array(self.line[first], pa.int32()), pa.array(self.line[last], pa.int32()), self.texts(first, last)]


_STOPS = frozenset(EVENTS)


def named(t: list[str], found: list[tuple]) -> list[tuple]:
    """Nodes of ``t`` with the kinds that their tokens give."""
    return [x if x[1] is not None else (x[0], statement_kind(t, x[2]), *x[2:]) for x in found]


def list_of(sizes: list[int], columns: list[pa.Array], kind: T.StructType) -> pa.ListArray:
    """Lists of structs from the fields of all of them, end to end."""
    rows = pa.StructArray.from_arrays(columns, names=kind.names)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), rows)


def _node_lists(found: list[list[tuple]]) -> pa.ListArray:
    """The nodes of many token lists as one Arrow column."""
    columns = list(zip(*[x for xs in found for x in xs])) or [()] * len(_NODE.fields)
    types = [pa.string() if f.dataType == T.StringType() else pa.int32() for f in _NODE]
    return list_of([len(xs) for xs in found], [pa.array(v, k) for v, k in zip(columns, types)], _NODE)


@F.arrow_udf(T.ArrayType(_NODE))
def _walked(t: pa.Array) -> pa.Array:
    return _node_lists([named(x, walk(x)) if x else [] for x in t.to_pylist()])


@F.arrow_udf(_PARSED)
def _walked_pieces(p: pa.Array) -> pa.Array:
    x = Sources(p)
    offsets = pa.array(x.offsets, pa.int32())
    of = lambda values: pa.ListArray.from_arrays(offsets, values)
    return pa.StructArray.from_arrays(
        [of(x.x.texts.take(pa.array(x.piece))), of(pa.array(x.at, pa.int32())), of(pa.array(x.line, pa.int32())),
         _node_lists([named(t, walk(t, stops)) for _, t, stops in x.rows()])], names=["t", "at", "line", "n"])


def nodes(t: Column) -> Column:
    """array<struct<role, kind, start, open, end, level, parent, parent_kind>> in
    the order in which the nodes begin; ``t`` stands outside of lambdas.

    Token indices are 0-based; ``end`` is the last token, or null for what the
    text leaves open.  ``parent`` is the opening brace of the scope around the
    node (-1: none), ``level`` the number of scopes around it.  Roles:
    ``scope`` (a brace and its kind, ``open`` is the brace), ``statement``,
    ``member`` (field or body-less method of a type), ``case`` (a label), and
    ``sub`` (the start of a statement that another one holds without braces)."""
    return _walked(t)


def parse(src: Column) -> Column:
    """struct(t: code tokens, at, line: their places, n: ``nodes``) of a text."""
    return _walked_pieces(pieces(src))
