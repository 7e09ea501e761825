"""Quote-aware token folds (A5, A6-A8, A11-A13) as Spark higher-order functions.

A lone ``"`` or ``'`` token opens a quoted region and the same token closes
it; the other quote kind inside is ignored.  Each fold walks one row's token
array once (``aggregate``); no Python, no explode.

Fold results are bound once with ``let`` before they are used inside other
lambdas; see ``trylens.functions.arrays.let``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .java import QUOTES, TERMINATORS, is_identifier


def scan(items: Column, init: Column, step, out_type: str, block: int = 16) -> Column:
    """A running fold with one output per item: struct(o: outputs, s: last state).

    ``step(state, item)`` gives struct(s: next state, o: an ``out_type``).  Outputs are
    gathered block by block, so appending copies a block and not all that went
    before.
    """
    def one(acc, x):
        return let(step(acc["s"], x), lambda r: F.struct(
            r["s"].alias("s"), F.concat(acc["o"], F.array(r["o"])).alias("o")))

    def part(acc, lo):
        own = F.aggregate(F.slice(items, lo + 1, block),
                          F.struct(acc["s"].alias("s"), F.array().cast(f"array<{out_type}>").alias("o")), one)
        return let(own, lambda r: F.struct(r["s"].alias("s"), F.concat(acc["o"], F.array(r["o"])).alias("o")))

    starts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1, F.lit(block))) \
              .otherwise(F.array().cast("array<int>"))
    zero = F.struct(init.alias("s"), F.array().cast(f"array<array<{out_type}>>").alias("o"))
    return F.aggregate(starts, zero, part, lambda a: F.struct(F.flatten(a["o"]).alias("o"), a["s"].alias("s")))


def _next_quote(q: Column, t: Column) -> Column:
    """Quote state after token ``t`` ('' = outside quotes)."""
    return (F.when(~t.isin(*QUOTES), q)
            .when(q == "", t)
            .when(q == t, F.lit(""))
            .otherwise(q))


def _events(tokens: Column, words: tuple[str, ...]) -> Column:
    """array<struct<t, i>>: the tokens among ``words`` with their 0-based index.

    A fold whose state only these change goes through them alone."""
    return F.filter(F.transform(tokens, lambda t, i: F.when(t.isin(*words), F.struct(t.alias("t"), i.alias("i")))),
                    lambda z: z.isNotNull())


def last_marker_index(tokens: Column, marker: str) -> Column:
    """0-based index of the last ``marker`` outside quotes; -1 if none."""
    init = F.struct(F.lit("").alias("q"), F.lit(-1).alias("idx"))

    def step(acc, z):
        hit = (z["t"] == marker) & (acc["q"] == "")
        return F.struct(
            F.when(hit, acc["q"]).otherwise(_next_quote(acc["q"], z["t"])).alias("q"),
            F.when(hit, z["i"]).otherwise(acc["idx"]).alias("idx"))

    return F.aggregate(_events(tokens, (marker, *QUOTES)), init, step, lambda acc: acc["idx"])


def brace_depth(tokens: Column) -> Column:
    """A5: open minus close braces among tokens outside quotes."""
    init = F.struct(F.lit("").alias("q"), F.lit(0).alias("d"))

    def step(acc, t):
        inside = acc["q"] != ""
        delta = (F.when(inside, 0).when(t == "{", 1).when(t == "}", -1).otherwise(0))
        return F.struct(_next_quote(acc["q"], t).alias("q"), (acc["d"] + delta).alias("d"))

    return F.aggregate(F.filter(tokens, lambda t: t.isin("{", "}", *QUOTES)), init, step, lambda acc: acc["d"])


def segment_statements(tokens: Column) -> Column:
    """Statement intervals ``array<struct<s:int,e:int>>`` (``e`` inclusive).

    A statement closes at ``{``, ``}`` or ``;`` outside quotes while the paren
    flag is off.  The flag is a boolean, not a depth: ``(`` sets it and any
    ``)`` clears it.  A trailing run with no terminator is not a statement.
    """
    init = F.struct(F.lit("").alias("q"), F.lit(False).alias("par"),
                    F.array().cast("array<int>").alias("ends"))

    def step(acc, z):
        q, t = acc["q"], z["t"]
        free = (~t.isin(*QUOTES)) & (q == "")
        close = free & t.isin(*TERMINATORS) & ~acc["par"]
        par = (F.when(close, acc["par"])
               .when(free & (t == "("), F.lit(True))
               .when(free & (t == ")"), F.lit(False))
               .otherwise(acc["par"]))
        ends = F.when(close, F.concat(acc["ends"], F.array(z["i"]))).otherwise(acc["ends"])
        return F.struct(_next_quote(q, t).alias("q"), par.alias("par"), ends.alias("ends"))

    def finish(acc):
        ends = acc["ends"]
        return F.transform(ends, lambda e, k: F.struct(
            F.when(k == 0, F.lit(0)).otherwise(F.element_at(ends, k) + 1).alias("s"),
            e.alias("e")))

    return F.aggregate(_events(tokens, (*QUOTES, *TERMINATORS, "(", ")")), init, step, finish)


def slice_seeds(back: Column) -> Column:
    """Identifiers of ``back`` followed by neither ``(`` nor an identifier.

    The last token never counts.  Distinct, in first-seen order.
    """
    def body(idf):
        def keep(t, i):
            nxt = F.try_element_at(back, i + 2)
            nxt_id = F.coalesce(F.try_element_at(idf, i + 2), F.lit(False))
            return F.element_at(idf, i + 1) & (i < F.size(back) - 1) & (nxt != "(") & ~nxt_id
        return F.array_distinct(F.filter(back, keep))
    return let(F.transform(back, is_identifier), body)


def _kept_statements(front: Column, idf: Column, stmts: Column, seeds: Column) -> Column:
    """The backward walk of A13: one keep flag per statement, last statement
    first; seeds grow on the way.

    ``idf`` holds the identifier flag of every token of ``front``.
    """
    n_front = F.size(front)
    init = F.struct(seeds.alias("seeds"),
                    F.array().cast("array<boolean>").alias("kept"))

    def step(acc, st):
        s0, ln = st["s"], st["e"] - st["s"] + 1
        # Lambdas get no common-subexpression elimination, so the statement
        # slice, the '=' position and the dependency test are bound once.
        sl = F.struct(F.slice(front, s0 + 1, ln).alias("t"), F.slice(idf, s0 + 1, ln).alias("d"))

        def with_slice(x):
            toks, ids = x["t"], x["d"]

            def with_eq(eq):                       # 1-based, 0 = none
                head_n = F.when(eq > 0, eq - 1).otherwise(F.size(toks))
                depend = F.exists(F.slice(F.arrays_zip(toks.alias("t"), ids.alias("d")), 1, head_n),
                                  lambda z: z["d"] & F.array_contains(acc["seeds"], z["t"]))

                def with_depend(dep):
                    # After the '=', identifiers at statement index i become
                    # seeds when front[i + 1] (an index into the whole front)
                    # is not '('.
                    grown = F.filter(toks, lambda t, i: (i >= eq - 1) & F.element_at(ids, i + 1)
                                     & (i < n_front - 1) & (F.try_element_at(front, i + 2) != "("))
                    seeds2 = F.when(dep & (eq > 0), F.array_union(acc["seeds"], grown)).otherwise(acc["seeds"])
                    return F.struct(seeds2.alias("seeds"), F.concat(acc["kept"], F.array(dep)).alias("kept"))
                return let(depend, with_depend)
            return let(F.array_position(toks, "=").cast("int"), with_eq)
        return let(sl, with_slice)

    return F.aggregate(F.reverse(stmts), init, step, lambda acc: acc["kept"])


def backward_slice_mask(front: Column, stmts: Column, seeds: Column) -> Column:
    """0/1 per token of ``front``: 1 inside a statement the try block depends on.

    ``stmts`` (A11 of ``front``) and ``seeds`` (A12 of the back part) are bound
    by the caller.  The first statement (the method header) is always kept;
    ``mask[s:e] = 1`` is end-exclusive, so each terminator stays 0.
    """
    # Statements tile front from index 0 without gaps, so the mask is built
    # statement by statement: a kept one gives 1s then a 0 for its terminator,
    # others 0s; tokens after the last one are 0.
    def with_flags(flags):
        n = F.size(flags)

        def piece(st, k):
            ones = F.when((k == 0) | F.element_at(flags, n - k), st["e"] - st["s"]).otherwise(F.lit(0))
            return F.concat(F.array_repeat(F.lit(1), ones),
                            F.array_repeat(F.lit(0), st["e"] - st["s"] + 1 - ones))
        covered = F.coalesce(F.try_element_at(stmts, F.lit(-1))["e"] + 1, F.lit(0))
        return F.concat(F.flatten(F.transform(stmts, piece)), F.array_repeat(F.lit(0), F.size(front) - covered))

    return let(F.transform(front, is_identifier),
               lambda idf: let(_kept_statements(front, idf, stmts, seeds), with_flags))
