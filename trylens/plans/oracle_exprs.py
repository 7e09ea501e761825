"""DuckDB SQL expression builders for the oracle queries.

Independent re-statements of the operator semantics in DuckDB's dialect
(``list_reduce`` with an initial struct, ``lambda`` syntax, 1-based lists).
"""

from __future__ import annotations

from ..functions.java import JAVA_RESERVED, PY_SPACE_CLASS

WS = PY_SPACE_CLASS
RESERVED_SQL = ", ".join(f"'{w}'" for w in JAVA_RESERVED)
QUOTES_SQL = "('\"', '''')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def lstrip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+', '')"


def split_ws(x: str) -> str:
    s = strip(x)
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({s}, '{WS}+') END)"


def clean_src(x: str) -> str:
    s1 = strip(x)
    s2 = (f"(CASE WHEN regexp_matches({s1}, '^\\w') THEN {s1} "
          f"ELSE regexp_replace({s1}, '^[^\\n]*?(\\w+)', ' \\1') END)")
    s3 = f"regexp_replace({s2}, '\\\\\\\\', ' ', 'g')"
    return f"regexp_replace({s3}, '\\\\ \"', ' \\\\\"', 'g')"


def is_ident(x: str) -> str:
    return (f"(coalesce(regexp_matches({x}, '^\\w') AND NOT regexp_matches({x}, '^\\d') "
            f"AND {x} NOT IN ({RESERVED_SQL}), false))")


def next_quote(q: str, t: str) -> str:
    return (f"(CASE WHEN {t} NOT IN {QUOTES_SQL} THEN {q} WHEN {q} = '' THEN {t} "
            f"WHEN {q} = {t} THEN '' ELSE {q} END)")


def last_marker(tokens: str, marker: str) -> str:
    return (f"list_reduce({tokens}, lambda acc, tk, ix: CASE WHEN tk = '{marker}' AND acc.q = '' "
            f"THEN struct_pack(q := acc.q, idx := CAST(ix - 1 AS INTEGER)) "
            f"ELSE struct_pack(q := {next_quote('acc.q', 'tk')}, idx := acc.idx) END, "
            f"struct_pack(q := '', idx := CAST(-1 AS INTEGER))).idx")


def py_slice(arr: str, start: str | None, stop: str | None) -> str:
    n = f"len({arr})"

    def norm(i: str) -> str:
        return f"(CASE WHEN ({i}) < 0 THEN greatest({n} + ({i}), 0) ELSE least({i}, {n}) END)"

    s = "0" if start is None else norm(start)
    e = n if stop is None else norm(stop)
    return f"(CASE WHEN {e} > {s} THEN list_slice({arr}, {s} + 1, {e}) ELSE []::VARCHAR[] END)"


def statements(tokens: str) -> str:
    free = f"(tk NOT IN {QUOTES_SQL} AND acc.q = '')"
    close = f"({free} AND tk IN ('{{', '}}', ';') AND NOT acc.par)"
    fold = (f"list_reduce({tokens}, lambda acc, tk, ix: struct_pack("
            f"q := {next_quote('acc.q', 'tk')}, "
            f"par := CASE WHEN {close} THEN acc.par WHEN {free} AND tk = '(' THEN true "
            f"WHEN {free} AND tk = ')' THEN false ELSE acc.par END, "
            f"ends := CASE WHEN {close} THEN list_append(acc.ends, CAST(ix - 1 AS INTEGER)) ELSE acc.ends END), "
            f"struct_pack(q := '', par := false, ends := []::INTEGER[])).ends")
    return fold


def intervals(ends: str) -> str:
    return (f"list_transform({ends}, lambda en, k: struct_pack("
            f"s := CAST(CASE WHEN k = 1 THEN 0 ELSE {ends}[k - 1] + 1 END AS INTEGER), e := en))")


def seeds(back: str) -> str:
    return (f"list_distinct(list_filter({back}, lambda b, bi: {is_ident('b')} AND bi < len({back}) "
            f"AND {back}[bi + 1] <> '(' AND NOT {is_ident(f'{back}[bi + 1]')}))")


def kept(front: str, stmts: str, seeds0: str) -> str:
    toks = f"list_slice({front}, st.s + 1, st.e + 1)"
    eq = f"coalesce(list_position({toks}, '='), 0)"
    head = f"(CASE WHEN {eq} > 0 THEN list_slice({toks}, 1, {eq} - 1) ELSE {toks} END)"
    depend = f"(len(list_filter({head}, lambda h: {is_ident('h')} AND list_contains(acc.seeds, h))) > 0)"
    grown = (f"list_filter({toks}, lambda g, gi: gi - 1 >= {eq} - 1 AND {is_ident('g')} "
             f"AND gi - 1 < len({front}) - 1 AND {front}[gi + 1] <> '(')")
    return (f"list_reduce(list_reverse({stmts}), lambda acc, st: struct_pack("
            f"seeds := CASE WHEN {depend} AND {eq} > 0 THEN list_distinct(list_concat(acc.seeds, {grown})) ELSE acc.seeds END, "
            f"kept := CASE WHEN {depend} THEN list_append(acc.kept, st) ELSE acc.kept END), "
            f"struct_pack(seeds := {seeds0}, kept := []::STRUCT(s INTEGER, e INTEGER)[])).kept")


def mask(front: str, stmts: str, kept_: str) -> str:
    allk = (f"(CASE WHEN len({stmts}) > 0 AND NOT list_contains({kept_}, {stmts}[1]) "
            f"THEN list_append({kept_}, {stmts}[1]) ELSE {kept_} END)")
    return (f"list_transform({front}, lambda mt, mk: CASE WHEN len(list_filter({allk}, "
            f"lambda iv: iv.s <= mk - 1 AND mk - 1 < iv.e)) > 0 THEN 1 ELSE 0 END)")


def json_list(x: str) -> str:
    return f"('[' || array_to_string({x}, ', ') || ']')"


def join_sp(x: str) -> str:
    return f"array_to_string({x}, ' ')"


def iv_text(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda iv: iv.s || '-' || iv.e), ',')"


def structural_stream(code: str) -> str:
    """A4 in DuckDB: token regex, per-token rules with neighbours, flatten, P9."""
    keywords = {"try": "TRY", "catch": "CatchClause", "return": "RETURN", "else": "ELSE", "throws": "throws"}
    control = "'if', 'for', 'while', 'switch', 'catch', 'synchronized', 'return', 'new', 'throw'"
    single = r"\]\[{}();,.="
    toks = f"regexp_extract_all({code}, '\"[^\"]*\"|[0-9A-Za-z_]+|[{single}]|[^\\s0-9A-Za-z_\"{single}]+')"
    prev = "(CASE WHEN i > 1 THEN tl[i - 1] ELSE '' END)"
    prev2 = "(CASE WHEN i > 2 THEN tl[i - 2] ELSE '' END)"
    nxt = "coalesce(tl[i + 1], '')"
    kw = " ".join(f"WHEN tk = '{k}' THEN ['{m}']" for k, m in keywords.items())
    rule = (f"CASE {kw} "
            "WHEN starts_with(tk, '\"') THEN list_filter(string_split(replace(tk, '\"', ''), ' '), lambda w: w <> '') "
            f"WHEN {is_ident('tk')} AND {nxt} = '(' AND tk NOT IN ({control}) THEN ['METHOD', 'INVOCATION', tk, 'arguments'] "
            f"WHEN {is_ident('tk')} AND {nxt} = '.' THEN ['qualifier', tk] "
            "WHEN tk = '.' THEN []::VARCHAR[] "
            f"WHEN {is_ident('tk')} AND {is_ident(nxt)} AND {prev} IN ('', '{{', '}}', ';', '(', ',', 'final') "
            "THEN ['VarDec', tk] "
            f"WHEN tk = '=' AND {is_ident(prev)} AND {is_ident(prev2)} THEN ['initializer'] "
            "ELSE [tk] END")
    flat = f"(SELECT flatten(list_transform(tl, lambda tk, i: {rule})) FROM (SELECT {toks} AS tl))"
    return (f"flatten(list_transform({flat}, lambda t: CASE WHEN length(t) > 2 "
            "THEN regexp_extract_all(t, '(\\w+|[.])') ELSE [t] END))")
