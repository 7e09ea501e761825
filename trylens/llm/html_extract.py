"""Operator 4: main text of web pages by equivalence-class template deduction.

The tokens of a page are its block elements, each as the path of its block
ancestors with class and id, and its blocks of text.  Elements of one host
whose occurrence vectors over the host's pages are equal form an equivalence
class; equality is tested on a 44-bit sum of per-page hashes times counts, so
vectors are never collected.  Of the classes that occur at most once a page
the tokens are valid whose tags have one place in the order of the class on
every page, when the class starts in one slot of the class around it; so they
nest into the host's template, whose slots are the stretches between two tags
of a class.  All text up to the next tag belongs to
the slot, text of repeated elements included.  Texts that come back on the
host's pages do not count as varying.  The element around the slot with the most
varying text outside links is extracted, with all of its text, and slots elsewhere with a fifth of
that text.  Names of tags and classes do not choose among slots: they strike
asides (navigation, notices, comments) unless that leaves next to nothing, and
article and main stand in on a page that has no slot of its host's template.

Plan: one scan counts tokens per host with map-side sums (a hot host is one
row per task and token), a second one nests the classes of each page and sums
places and amounts of text per slot, a third extracts.  A host's template is
bounded by a few pages' structure.

Defined cases: null or empty html has empty text; a null url is host "";
repeated pages each get their row; unclosed, crossed and unknown elements
close with their parent, only an unclosed script or style runs to the end; from
a tag on whose quotes do not close, tags end at the next ``>``; texts are never
cut, and pages of any length take one pass; of equal slots the first by number
is the article; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

# Element classes of HTML (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
HIDDEN = frozenset("noscript template svg select datalist optgroup option button annotation annotation-xml".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var br wbr img math semantics mi mn mo ms mtext mrow "
                   "mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts mspace "
                   "mstyle mpadded mphantom menclose mtable mtr mtd".split())
# A hidden control or drawing that is still open ends where one of these starts.
ENDS_HIDDEN = frozenset("article main section header footer nav p h1 h2 h3 h4 h5 h6".split())
ASIDE = frozenset("nav header footer aside form menu dialog figcaption".split())
# Elements that are lines of a text, never all of it.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote ul ol dl li dt dd".split())
_ASIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|header|footer|sidebar|"
    r"side-?bar|cookies?\w*|notice|consent|popup|modal|newsletter|subscribe|share|social|related|widget|comments?|"
    r"disqus|respond|login|search)(?:$|[\s_-])", re.I)
_OPEN = re.compile(r"<(/?+)([a-zA-Z][^\s/>]*+)")
# a whole tag whose quotes close; possessive, so it is read once
_TAG = re.compile(_OPEN.pattern + r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_NAME = re.compile(r"\b(class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
              "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_PATH = 256            # characters of a path that is kept as it is
MIN_SHARE = 0.5        # a template token is on at least this share of its host's pages


_SHORT = 256           # characters of attributes whose names are remembered


@lru_cache(maxsize=1 << 14)
def _short_names(attributes: str) -> str:
    return " ".join(sorted({w for x in _NAME.findall(attributes) for w in (x[1] or x[2] or x[3]).split()}))


def _names(attributes: str) -> str:
    """The words of class and id, in order."""
    if not attributes:
        return ""
    return (_short_names if len(attributes) <= _SHORT else _short_names.__wrapped__)(attributes)


@lru_cache(maxsize=1 << 14)
def _short_aside(names: str) -> bool:
    return _ASIDE_NAME.search(names) is not None


def _is_aside(names: str) -> bool:
    return (_short_aside if len(names) <= _SHORT else _short_aside.__wrapped__)(names)


@lru_cache(maxsize=64)
def _end_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


class Node:
    __slots__ = ("tag", "path", "aside", "main", "hidden", "block", "parent")

    def __init__(self, tag: str, parent: "Node | None", names: str):
        self.tag = tag
        self.parent = parent
        self.hidden = bool(parent and parent.hidden) or tag in HIDDEN or tag == "head"
        # elements inside a hidden one are no blocks: they do not end a paragraph
        self.block = parent.block if parent and (tag in HIDDEN or parent.block is not parent) else self
        label = f"{tag}.{names}" if names else tag
        path = f"{parent.path}/{label}" if parent else label
        # a deep element's path is a hash, so that paths stay short at any depth
        self.path = path if len(path) <= _PATH else xxhash.xxh64_hexdigest(path)
        self.aside = bool(parent and parent.aside) or tag in ASIDE or tag == "head" \
            or bool(names and tag not in ("body", "html", "article", "main") and _is_aside(names))
        self.main = bool(parent and parent.main) or tag in ("article", "main")


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing?, name, attributes) of every tag, in one pass; the
    name is empty for comments and declarations.

    A quoted value may hold ``>``.  From the first tag on whose quotes do not
    close, tags end at the next ``>``, so no stretch is read again and again."""
    at, loose = 0, False
    while True:
        i = page.find("<", at)
        if i < 0:
            return
        m = None if loose else _TAG.match(page, i)
        if m is not None:
            at = m.end()
            skip = yield i, at, bool(m[1]), m[2].lower(), m[3]
            if skip is not None:
                at = skip
                yield i, at, False, "", ""
            continue
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            at = len(page) if j < 0 else j + 3
            yield i, at, False, "", ""
            continue
        if page.startswith(("<!", "<?"), i):
            j = page.find(">", i + 2)
            if j < 0:
                return
            at = j + 1
            yield i, at, False, "", ""
            continue
        m = _OPEN.match(page, i)
        if m is None:
            at = i + 1
            continue
        loose, j = True, page.find(">", m.end())
        if j < 0:
            return
        at = j + 1
        # what follows a skipped element is looked for behind it
        skip = yield i, at, bool(m[1]), m[2].lower(), page[m.end():j]
        if skip is not None:
            at = skip
            yield i, at, False, "", ""


class Stack(list):
    """Open elements, with a count by tag: whether one is open is one look."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.count: Counter = Counter([root.tag])

    def append(self, node: Node) -> None:
        super().append(node)
        self.count[node.tag] += 1

    def cut(self, k: int) -> None:
        """Close the elements from place ``k`` on."""
        while len(self) > k:
            self.count[super().pop().tag] -= 1

    def last(self, tag: str) -> int:
        """Place of the innermost open ``tag``, 0 if there is none."""
        if not self.count[tag]:
            return 0
        return next((k for k in range(len(self) - 1, 0, -1) if self[k].tag == tag), 0)


def walk(page: str) -> Iterator[tuple[str, Node, str, bool]]:
    """('open', node, '', False) for every block element and ('text', node,
    raw text, inside a link?) for text; ('br', ...) where an end tag ends a block."""
    stack, links, at = Stack(Node("#", None, "")), 0, 0
    ends: dict[str, int] = {}                # last place of an end tag, for elements that need one
    found = tags(page)
    for start, stop, closing, tag, attributes in found:
        if start > at:
            yield "text", stack[-1], page[at:start], links > 0
        at = stop
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if closing else 1
            elif tag == "br":
                yield "text", stack[-1], " ", False
            continue
        if tag in RAW and not closing:
            if not attributes.endswith("/"):
                end = None
                if ends.get(tag) != -1:
                    end = _end_tag(tag).search(page, at)
                if end:
                    at = end.end()
                    found.send(at)
                elif tag in ("script", "style"):
                    return
                else:
                    ends[tag] = -1
            continue
        if tag in ("noscript", "template") and not closing:
            if tag not in ends:
                ends[tag] = max((e.start() for e in re.finditer(rf"</{tag}\s*>", page, re.I)), default=-1)
            if ends[tag] < at:               # never closed: the tag alone is left out
                continue
        if not closing and stack[-1].tag == "head" and tag not in VOID and tag not in HIDDEN:
            stack.cut(len(stack) - 1)        # the end tag of head may be left out
        if not closing and tag in ENDS_HIDDEN and not stack.count["noscript"] and not stack.count["template"]:
            while stack[-1].block is not stack[-1]:
                stack.cut(len(stack) - 1)
        if tag in HIDDEN or stack[-1].block is not stack[-1]:
            if not closing:
                while tag in ("option", "optgroup") and stack[-1].tag == "option":
                    stack.cut(len(stack) - 1)
                if tag not in VOID and not attributes.endswith("/"):
                    stack.append(Node(tag, stack[-1], ""))
                continue
            k = stack.last(tag)
            if not k or stack[k].block is not stack[k]:
                if k:
                    stack.cut(k)
                continue
        if closing:
            yield "br", stack[-1], "", False
            k = stack.last(tag)
            if k:
                stack.cut(k)
                links = 0
            continue
        if stack[-1].tag == "p":                      # a block element ends an open paragraph
            stack.cut(len(stack) - 1)
        while len(stack) > 1 and stack[-1].tag in _CLOSED_BY.get(tag, ()):
            stack.cut(len(stack) - 1)
        node = Node(tag, stack[-1], _names(attributes))
        yield "open", node, "", False
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
    if page[at:]:
        yield "text", stack[-1], page[at:], links > 0


@lru_cache(maxsize=1 << 16)
def _key(path: str) -> int:
    return xxhash.xxh64_intdigest(path) >> 2


def _text_key(node: Node, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{node.path}\n{text}") >> 2


def events(page: str) -> Iterator[tuple[str, Node, str, int, int]]:
    """('open' | 'close', element, '', 0, 0) for every block element, in page
    order, and ('text', its element, text, characters outside links, in links)
    for every block of text that is not hidden."""
    stack: list[Node] = []
    parts: list[str] = []
    plain = linked = 0
    at: Node | None = None

    def block():
        return " ".join(entities.unescape("".join(parts)).split())

    for kind, node, text, in_link in walk(page):
        if kind == "text":
            # white space before a block's text is no part of it
            if not node.hidden and (parts or not text.isspace()):
                parts.append(text)
                n = len("".join(text.split()))
                if in_link:
                    linked += n
                else:
                    plain += n
                at = node.block
            continue
        if parts:
            text = block()
            if text:
                while stack and stack[-1] is not at:
                    yield "close", stack.pop(), "", 0, 0
                yield "text", at, text, plain, linked
            parts.clear()
            plain = linked = 0
        if kind == "open":
            around = node.parent.block
            while stack and stack[-1] is not around:
                yield "close", stack.pop(), "", 0, 0
            stack.append(node)
            yield "open", node, "", 0, 0
    if parts:
        text = block()
        if text:
            while stack and stack[-1] is not at:
                yield "close", stack.pop(), "", 0, 0
            yield "text", at, text, plain, linked
    while stack:
        yield "close", stack.pop(), "", 0, 0


def page_tokens(page: str) -> dict[int, list]:
    """token -> [is a text block?, occurrences]"""
    out: dict[int, list] = {}
    for kind, node, text, _, _ in events(page):
        if kind == "open":
            out.setdefault(_key(node.path), [False, 0])[1] += 1
        elif kind == "text":
            out.setdefault(_text_key(node, text), [True, 0])[1] += 1
    return out


def host_tokens(pages: DataFrame) -> DataFrame:
    """(host, token, is_text, vector, n, pages, seen) per host; ``seen`` has a
    bit per hash class of the contents of the token's pages, so that copies of
    one page do not count as several."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in c.slices(batches, "html"):
            hosts, ids, texts = (x.to_pylist() for x in c.columns(b, ["host", "page_id", "html"]))
            sums: dict[tuple, list] = {}
            for host, page_id, text in zip(hosts, ids, texts):
                text = text or ""
                salt = xxhash.xxh64_intdigest(f"{page_id}|{len(text)}")
                bit = 1 << (xxhash.xxh64_intdigest(text) % 62)
                for token, (is_text, n) in page_tokens(text).items():
                    s = sums.setdefault((host, token), [is_text, 0, 0, 0, 0])
                    s[1] = (s[1] + salt * n) % (1 << 44)
                    s[2] += n
                    s[3] += 1
                    s[4] |= bit
            cols = list(zip(*[(h, k, *v) for (h, k), v in sums.items()])) or [[]] * 7
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(cols, kinds)],
                names=["host", "token", "is_text", "vector", "n", "pages", "seen"])

    parts = pages.mapInArrow(run, "host string, token long, is_text boolean, vector long, n long, pages long, seen long")
    return parts.groupBy("host", "token", "is_text").agg(
        F.pmod(F.sum("vector"), F.lit(1 << 44)).alias("vector"), F.sum("n").alias("n"), F.sum("pages").alias("pages"),
        F.bit_or("seen").alias("seen"))


def candidates(tokens: DataFrame, hosts: DataFrame) -> DataFrame:
    """One row per host: the tokens that may be in its template.

    Elements occur once on each page that has them and, as texts, on at least
    ``MIN_SHARE`` of the host's pages; at most a few pages' worth of tokens
    passes, so the list is bounded."""
    seen = F.bit_count("seen")
    x = tokens.join(hosts, "host").where(
        (F.col("pages") >= F.col("host_pages") * MIN_SHARE)
        & F.when(F.col("is_text"), seen >= 2).otherwise(F.col("n") == F.col("pages")))
    return x.groupBy("host").agg(F.collect_list(F.struct("token", "vector", "is_text")).alias("members"))


class Template:
    """Classes of element tokens, nested by their order on a page.

    A slot is the stretch after one start or end tag of a class up to the next
    tag of that class (``slot`` = 2 * token, + 1 after its end tag; 0 before
    any).  A class that starts inside a slot is nested in it until the last of
    its elements has ended; then the outer slot goes on."""

    def __init__(self, members: list[dict]):
        self.cls = {m["token"]: m["vector"] for m in members if not m["is_text"]}
        self.size = Counter(self.cls.values())
        self.texts = {m["token"] for m in members if m["is_text"]}

    def run(self, page: str) -> Iterator[tuple]:
        """('tag', slot it starts, class, slot around a class that starts here
        or None, innermost template element but ``LINES``) and ('text', slot, element, text,
        plain, linked)."""
        nest: list[list] = []              # class, slot, elements ended
        around = [0]                       # template elements that are open
        for kind, node, text, plain, linked in events(page):
            slot = nest[-1][1] if nest else 0
            if kind == "text":
                yield "text", slot, node, text, plain, linked
                continue
            token = _key(node.path)
            cls = self.cls.get(token)
            if cls is None:
                continue
            outer = None
            if any(x[0] == cls for x in nest):
                while nest[-1][0] != cls:
                    nest.pop()
            else:
                outer = slot
                nest.append([cls, 0, 0])
            if kind == "open":
                nest[-1][1] = 2 * token
                if node.tag not in LINES:
                    around.append(token)
            else:
                nest[-1][1] = 2 * token + 1
                nest[-1][2] += 1
                if node.tag not in LINES:
                    around.pop()
            yield "tag", nest[-1][1], cls, outer, around[-1]
            if nest[-1][2] >= self.size[cls]:
                nest.pop()


AMOUNTS = ("varied", "plain", "linked", "varied_all", "plain_all", "linked_all")
MEASURES = "host string, kind int, id long, cls long, within long, low long, high long, " \
           + ", ".join(f"{x} long" for x in AMOUNTS)


def slot_measures(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """Per host: one row per slot (kind 0: its class, innermost element, least
    and greatest place of its tag in the class, amounts of text without and
    with asides) and per class (kind 1: least and greatest slot around it)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template] = {}
        for b in c.slices(batches, "html"):
            hosts, texts = (x.to_pylist() for x in c.columns(b, ["host", "html"]))
            members, = c.columns(b, ["members"])
            if len(known) > 1000:
                known.clear()
            sums: dict[tuple, list] = {}

            def add(key, cls, within, at):
                s = sums.get(key)
                if s is None:
                    sums[key] = [cls, within, at, at, 0, 0, 0, 0, 0, 0]
                else:
                    s[2], s[3] = min(s[2], at), max(s[3], at)

            for i, (host, page) in enumerate(zip(hosts, texts)):
                if host not in known:            # the same on every page of a host
                    known[host] = Template(members[i].as_py() or [])
                t = known[host]
                place: Counter = Counter()
                add((host, 0, 0), 0, 0, 0)
                for e in t.run(page or ""):
                    if e[0] == "tag":
                        _, slot, cls, outer, within = e
                        add((host, 0, slot), cls, within, place[cls])
                        place[cls] += 1
                        if outer is not None:
                            add((host, 1, cls), cls, 0, outer)
                        continue
                    _, slot, node, text, plain, linked = e
                    varied = plain if _text_key(node, text) not in t.texts else 0
                    s = sums[(host, 0, slot)]
                    for k, n in enumerate((varied, plain, linked)):
                        s[7 + k] += n
                        if not node.aside:
                            s[4 + k] += n
            cols = list(zip(*[(*k, *v) for k, v in sums.items()])) or [[]] * 13
            kinds = (pa.string(), pa.int32(), *[pa.int64()] * 11)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds)],
                                             names=[x.split()[0] for x in MEASURES.split(", ")])

    x = pages.join(plan, "host", "left").select("host", "html", "members").mapInArrow(run, MEASURES)
    return x.groupBy("host", "kind", "id").agg(
        *[F.max(k).alias(k) for k in ("cls", "within", "high")], F.min("low").alias("low"),
        *[F.sum(k).alias(k) for k in AMOUNTS])


def choose(members: list[dict], measures: list[dict]) -> tuple[list[int], list[int], bool]:
    """(valid element tokens, slots to extract, asides too?) of a host.

    A token is valid when its tags have one place in their class on all pages
    and the class always starts in one slot; the text of an invalid one goes
    to the element around.  The element around the slot with the most text that
    varies between pages and is not in links is the article: its slots are
    extracted, and slots elsewhere with at least a fifth of that text.  Asides
    are struck unless that leaves less than a fifth of the heaviest slot."""
    nested = {x["cls"] for x in measures if x["kind"] == 1 and x["low"] == x["high"]}
    slots = {x["id"]: x for x in measures if x["kind"] == 0}
    above = {s // 2: x["within"] for s, x in slots.items() if s % 2}
    valid = {s // 2 for s, x in slots.items() if s} - {
        s // 2 for s, x in slots.items() if x["low"] != x["high"] or x["cls"] not in nested}
    tokens = [m["token"] for m in members if not m["is_text"] and m["token"] in valid]

    def chain(slot):                       # the valid elements around a slot
        e = slots[slot]["within"] if slot else 0
        while e:
            if e in valid:
                yield e
            e = above.get(e, 0)

    total: dict[int, dict] = {}
    for slot, x in slots.items():
        home = slot if slot // 2 in valid else 2 * next(chain(slot), 0)
        t = total.setdefault(home, dict.fromkeys(AMOUNTS, 0))
        for k in AMOUNTS:
            t[k] += x[k]
    for amount in ("varied", "plain"):
        weight = {s: x[amount] - x["linked"] for s, x in total.items()}
        most = max(weight.values(), default=0)
        wider = {s: x[f"{amount}_all"] - x["linked_all"] for s, x in total.items()}
        asides = max(wider.values(), default=0) > 5 * max(most, 0)
        if asides:
            weight, most = wider, max(wider.values())
        if most > 0:
            break
    else:
        return tokens, [], False
    # of equal slots the first by number, so that a run can be repeated
    article = next(chain(min(s for s, w in weight.items() if w == most)), 0)
    linked, plain = ("linked_all", "plain_all") if asides else ("linked", "plain")
    take = [s for s in weight if weight[s] * 5 >= most
            or (article and article in chain(s) and total[s][linked] <= total[s][plain])]
    return tokens, take, asides


def templates(plan: DataFrame, measures: DataFrame) -> DataFrame:
    """One row per host: its template as (tokens with class, slots, texts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for host, members, rows in zip(*(x.to_pylist() for x in c.columns(b, ["host", "members", "rows"]))):
                tokens, take, asides = choose(members or [], rows)
                keep = set(tokens)
                left = [m for m in members or [] if m["token"] in keep]
                out.append((host, left, take, asides))
            hosts, left, take, asides = list(zip(*out)) or [[]] * 4
            member = pa.struct([("token", pa.int64()), ("vector", pa.int64()), ("is_text", pa.bool_())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(left, pa.list_(member)),
                 pa.array(take, pa.list_(pa.int64())), pa.array(asides, pa.bool_())],
                names=["host", "members", "take", "asides"])

    rows = measures.groupBy("host").agg(F.collect_list(F.struct(*[x for x in measures.columns if x != "host"])).alias("rows"))
    return rows.join(plan, "host", "left").select("host", "members", "rows").mapInArrow(
        run, "host string, members array<struct<token:long,vector:long,is_text:boolean>>, "
             "take array<long>, asides boolean")


def main_text(page: str, template: Template, take: set[int], asides: bool) -> str:
    """Text blocks of the page's extracted slots, one per line, without the
    asides in them (notices, forms, comments).

    A page that has no such text gives its own article, else its body."""
    blocks: list[str] = []
    main: list[str] = []
    wider: list[str] = []
    for e in template.run(page):
        if e[0] != "text":
            continue
        _, slot, node, text, _, _ = e
        if node.aside and not asides:
            continue
        wider.append(text)
        if node.main:
            main.append(text)
        if slot in take:
            blocks.append(text)
    return "\n".join(blocks or main or wider)


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page of ``pages`` (page_id, url, html)."""
    pages = with_host(pages)
    hosts = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    plan = c.materialize(candidates(host_tokens(pages.select("host", "page_id", "html")), hosts), "html-tokens")
    measures = slot_measures(pages.select("host", "html"), plan)
    chosen = c.materialize(templates(plan, measures), "html-templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for b in c.slices(batches, "html"):
            ids, urls = c.columns(b, ["page_id", "url"])
            hosts_, texts = (x.to_pylist() for x in c.columns(b, ["host", "html"]))
            template = c.columns(b, ["members", "take", "asides"])
            if len(known) > 1000:
                known.clear()
            out = []
            for i, (host, text) in enumerate(zip(hosts_, texts)):
                if host not in known:            # the same on every page of a host
                    t = [x[i].as_py() for x in template]
                    known[host] = Template(t[0] or []), set(t[1] or ()), bool(t[2])
                out.append(main_text(text or "", *known[host]))
            yield pa.RecordBatch.from_arrays(
                [ids, urls, pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return (pages.join(chosen, "host", "left").select("page_id", "url", "host", "html", "members", "take", "asides")
                 .mapInArrow(run, "page_id long, url string, text string, n_chars long"))
