"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page becomes a tree of block elements and text slots. In each element, neighbours that repeat one another are folded
into a repeated group, and the children of one place on two pages are aligned: what both have is joined, what only one
has becomes optional, a text that differs becomes an open slot and one that never does a fixed one. Where a name still
stands in many places of one element, the element's content becomes a repeated group of optional parts, so wrappers do
not grow with the pages. Every task infers wrappers from its own pages, and those of a host are aligned in a tree, a few
at a time, so no task sees more than a few wrappers of a host of any size.

The wrapper then decides by place: from the root down, the element that holds most of the host's open text, until it
has no such child or is an article, is the main text. Names of elements and classes are hints on single elements, which
the wrapper can overrule: an element that holds an article, or most of the host's text, is no furniture. Pages are
aligned with their host's wrapper once more, and each text follows its slot.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Element names of the HTML standard, and words in class, id or role that name page furniture.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = "script|style|title|textarea|noscript|template|iframe|svg|object|select|button|canvas|audio|video|math"
FURNITURE_TAGS = frozenset("head nav footer aside form dialog menu".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside complementary footer contentinfo header masthead comment comments disqus respond reply replies "
    "share sharing social related recommended newsletter subscribe subscription signup login search pagination pager toc widget toolbar skip".split()
)
ENDS_P = BLOCKS - {"head", "html", "body"}
CLOSES = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
#: Words that may stand beside a furniture word in one class name.
MODIFIERS = frozenset("site main page top bottom left right global primary secondary box list area wrap wrapper container inner outer block section bar item links count post content".split())

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<skip>" + SKIPPED + r")\b(?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+>(?:.*?</(?P=skip)\b[^>]*+>?|.*)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)>?|<[!?/][^>]*+>?",
    re.DOTALL | re.IGNORECASE,
)
_names = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_digits = re.compile(r"[0-9]+")
_part = re.compile(r"[a-z]+")

#: Elements that go by their tag alone, whatever their classes say of the page.
BARE = frozenset("html head body main article".split())
DEPTH = 200  # elements below are not told apart: their texts belong to the element at that depth
FIXED_PAGES = 5  # pages from which on a text that never differs counts as fixed
PLACES = 12  # of one name in an element, beyond which its content becomes a repeated group of optional parts
MERGE = 8  # wrappers of a host that one task aligns
HELD_NODES = 200_000  # of all hosts' wrappers in a task, beyond which it hands them on
PRIOR = 4  # how much more the text of an article or main element weighs
LINKS = 0.8
BROADCAST_BYTES = 8 << 20
NOTHING, MAIN, FURNITURE = 0, 1, 2


@dataclass(slots=True)
class Node:
    """An element with its content, or a text slot ("#") of a page or of a wrapper."""

    key: str
    pages: int = 1
    repeated: bool = False
    kids: list[Node] = field(default_factory=list)
    chars: int = 0  # of a slot's texts
    links: int = 0  # those inside links
    fixed: str | None = None  # a slot's text, as a hash, if it never differs
    blocks: list[int] = field(default_factory=list)  # of a page's slot: its texts

    def packed(self) -> list:
        return [self.key, self.pages, int(self.repeated), [k.packed() for k in self.kids], self.chars, self.links, self.fixed]

    @staticmethod
    def unpacked(x: list) -> Node:
        return Node(x[0], x[1], bool(x[2]), [Node.unpacked(k) for k in x[3]], *x[4:])


def class_names(attrs: str) -> list[str]:
    return sorted({n for x in _names.finditer(attrs) for n in _digits.sub("", (x[2] or x[3] or x[4] or "").lower()).split() if n})


def furniture_class(name: str) -> bool:
    """A furniture word, or made up of such words and modifiers (site-footer; not has-sidebar or comments-open)."""
    parts = set(_part.findall(name))
    return bool(parts & FURNITURE_WORDS) and parts <= FURNITURE_WORDS | MODIFIERS


def parse(source: str | None) -> tuple[Node, list[str]]:
    """The page as a tree, folded, and its texts in order. Null: nothing. Tags that are not closed, not opened or
    crossed lose no text; the work grows with the length."""
    root, texts = Node(""), []
    stack: list[tuple[str, Node]] = [("", root)]  # tag, node; elements below DEPTH share their ancestor's node
    opened: Counter[str] = Counter()
    run: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        words = entities.unescape("".join(run)).split()
        run.clear()
        if words:
            text = " ".join(words)
            slot = Node("#", 1, False, [], len(text), min(linked, len(text)), hashlib.md5(text.encode("utf-8", "replace")).hexdigest()[:16], [len(texts)])
            texts.append(text)
            stack[-1][1].kids.append(slot)
        linked = 0

    def pop() -> None:
        tag, node = stack.pop()
        opened[tag] -= 1
        if stack[-1][1] is not node:
            node.kids = fold(node.kids)

    def say(text: str) -> None:
        nonlocal linked
        run.append(text)
        if in_link:
            linked += len(text.strip())

    source = source or ""
    at = 0
    for m in _token.finditer(source):
        if m.start() > at:
            say(source[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = 0 if m["close"] else 1
        if m["close"]:
            if opened[tag] > 0:
                if tag not in BLOCKS and stack[-1][0] in BLOCKS:
                    continue  # an inline end tag does not close a block
                flush()
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in ("br", "hr"):
            run.append(" ")
        names = class_names(m["attrs"]) if m["attrs"] else []
        if tag not in BLOCKS and (tag in VOID or not any(map(furniture_class, names))):
            continue
        flush()
        if tag == "body":
            while opened["head"] > 0:
                pop()
        if tag in ENDS_P and opened["p"] > 0:
            while stack[-1][0] not in BLOCKS and stack[-1][0]:
                pop()
            if stack[-1][0] == "p":
                pop()
        if tag in CLOSES:
            shut, stop = CLOSES[tag]
            shut = shut.split()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in stop:
                    break
                if stack[k][0] in shut:
                    while len(stack) > k:
                        pop()
        if tag in VOID:
            continue
        opened[tag] += 1
        if len(stack) > DEPTH:
            stack.append((tag, stack[-1][1]))
            continue
        node = Node(tag if tag in BARE else ".".join([tag, *names]))
        stack[-1][1].kids.append(node)
        stack.append((tag, node))
    if at < len(source):
        say(source[at:])
    flush()
    while len(stack) > 1:
        pop()
    root.kids = fold(root.kids)
    return root, texts


def join(a: Node, b: Node, same_page: bool) -> Node:
    """One node for two of one key."""
    pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
    kids = align(a.kids, b.kids, pages, same_page) if a.kids or b.kids else []
    return Node(a.key, pages, a.repeated or b.repeated or same_page, kids, a.chars + b.chars, a.links + b.links, a.fixed if a.fixed == b.fixed else None, a.blocks + b.blocks)


def fold(items: list[Node]) -> list[Node]:
    """Neighbouring groups of equal keys become one repeated group. Each item looks for a repetition that ends with it,
    as long as the way back to the last item of its key; running hashes compare the two groups at once."""
    out: list[Node] = []
    sums = [0]
    last: dict[str, list[int]] = {}
    base, mod = 1_000_003, (1 << 61) - 1
    power = [1]

    def put(x: Node) -> None:
        last.setdefault(x.key, []).append(len(out))
        out.append(x)
        sums.append((sums[-1] * base + hash(x.key)) % mod)
        if len(power) <= len(out):
            power.append(power[-1] * base % mod)

    for x in items:
        put(x)
        n = len(out)
        before = last[x.key]
        period = n - 1 - before[-2] if len(before) > 1 else n
        if 2 * period <= n:
            code = lambda i, j: (sums[j] - sums[i] * power[j - i]) % mod
            if code(n - 2 * period, n - period) == code(n - period, n):
                for i in range(n - period, n):
                    out[i - period] = join(out[i - period], out[i], True)
                for y in out[n - period :]:
                    last[y.key].pop()
                del out[n - period :], sums[n - period + 1 :]
    return grouped(out, 1, True)


def grouped(items: list[Node], pages: int, same_page: bool) -> list[Node]:
    """The items, or one repeated, optional item a key where one of them stands in too many places."""
    if len(items) <= PLACES or max(Counter(x.key for x in items).values()) <= PLACES:
        return items
    by: dict[str, Node] = {}
    for x in items:
        if x.key in by:
            y = join(by[x.key], x, same_page)
            y.pages, y.repeated = min(y.pages, pages), True
            by[x.key] = y
        else:
            by[x.key] = x
    return list(by.values())


def align(a: list[Node], b: list[Node], pages: int, same_page: bool = False) -> list[Node]:
    """Contents of one place joined; what only one side has is optional, as it stands on fewer pages than its parent."""
    keys = [[x.key for x in side] for side in (a, b)]
    if keys[0] == keys[1]:
        return [join(x, y, same_page) for x, y in zip(a, b, strict=True)]
    out: list[Node] = []
    for op, i, k, m, n in SequenceMatcher(None, *keys, autojunk=False).get_opcodes():
        if op == "equal":
            out += [join(x, y, same_page) for x, y in zip(a[i:k], b[m:n], strict=True)]
        else:
            out += a[i:k]
            out += b[m:n]
    return grouped(out, pages, same_page)


def nodes(x: Node) -> int:
    return 1 + sum(map(nodes, x.kids))


def verdicts(root: Node) -> list:
    """[key, verdict, contents] for the parts of a wrapper that lead to a verdict: MAIN or FURNITURE from there on."""
    mark: dict[int, int] = {}
    whole: dict[int, int] = {}
    mass: dict[int, int] = {}

    def weigh(x: Node) -> tuple[int, bool]:
        got = [weigh(k) for k in x.kids]
        whole[id(x)] = x.chars + sum(n for n, _ in got)
        return whole[id(x)], x.key in ("article", "main") or any(f for _, f in got)

    weigh(root)
    total = whole[id(root)]

    def hints(x: Node, inside: bool) -> bool:
        """Marks furniture; does x hold an article?"""
        tag, *names = x.key.split(".")
        own = tag in ("article", "main")
        holds = own | any([hints(k, inside or own) for k in x.kids])
        by_tag = tag in FURNITURE_TAGS or tag == "header" and not inside
        by_class = tag not in BARE and any(map(furniture_class, names)) and 2 * whole[id(x)] <= total
        if (by_tag or by_class) and not holds:
            mark[id(x)] = FURNITURE
        return holds

    hints(root, False)

    def weight(x: Node) -> int:
        own = 0 if mark.get(id(x)) else (0 if is_fixed(x, root.pages) else x.chars) + sum(map(weight, x.kids))
        mass[id(x)] = own * (PRIOR if x.key in ("article", "main") else 1)
        return own

    weight(root)

    def descend(x: Node) -> None:
        open_ = [k for k in x.kids if not mark.get(id(k))]
        titled = any(k.key.split(".")[0] in ("h1", "h2") and mass[id(k)] for k in open_)
        best = []
        if x.key != "article" and not titled:
            for k in open_:
                # Others count as far as they would stand on the same pages if places were independent.
                others = sum(mass[id(o)] for o in x.kids if o is not k) * min(1.0, k.pages / max(1, x.pages))
                if k.kids and not k.repeated and mass[id(k)] > others:
                    best.append(k)
        for k in best:
            descend(k)
        if not best:
            mark[id(x)] = MAIN
            if x.key in ("", "html", "body"):  # no element of the page holds it: the template's own texts and menus go by themselves
                for k in open_:
                    if is_fixed(k, root.pages) or whole[id(k)] and k.kids and link_share(k) >= LINKS:
                        mark[id(k)] = FURNITURE

    descend(root)

    def told(x: Node) -> list:
        kids = [told(k) for k in x.kids]
        return [x.key, mark.get(id(x), NOTHING), kids if any(k[1] or k[2] for k in kids) else []]

    return told(root)


def is_fixed(x: Node, pages: int) -> bool:
    return x.key == "#" and x.fixed is not None and x.pages >= FIXED_PAGES and 2 * x.pages > pages


def link_share(x: Node) -> float:
    def sums(y: Node) -> tuple[int, int]:
        got = [sums(k) for k in y.kids]
        return y.chars + sum(g[0] for g in got), y.links + sum(g[1] for g in got)

    chars, links = sums(x)
    return links / max(1, chars)


def kept_blocks(told: list, page: Node) -> list[int]:
    """The page's texts in slots that the wrapper's verdicts hold for main text. A part that the wrapper has elsewhere
    in the same element goes by that place, one that it does not know by the element."""
    out: list[int] = []

    def walk(mine: list, x: Node, state: int) -> None:
        if x.key == "#":
            if state == MAIN:
                out.extend(x.blocks)
            return
        met: dict[int, list] = {}
        if mine:
            keys = [[k[0] for k in mine], [k.key for k in x.kids]]
            for i, m, n in SequenceMatcher(None, *keys, autojunk=False).get_matching_blocks() if keys[0] != keys[1] else [(0, 0, len(mine))]:
                met.update((m + j, mine[i + j]) for j in range(n))
            by_key = {k[0]: k for k in reversed(mine)}
            met.update((j, by_key[k.key]) for j, k in enumerate(x.kids) if j not in met and k.key in by_key)
        for j, k in enumerate(x.kids):
            other = met.get(j, [k.key, NOTHING, []])
            walk(other[2], k, other[1] or state)

    walk(told[2], page, told[1])
    return sorted(out)


def main_text(source: str | None, told: list | None) -> str:
    """The page's main text by its host's verdicts. None, or a page without the part that holds its host's main text: as
    if it were the only page of its host."""
    page, texts = parse(source)
    kept = kept_blocks(told, page) if told else []
    return "\n".join(texts[i] for i in kept or kept_blocks(verdicts(page), page))


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def both(a: Node, b: Node) -> Node:
    return join(a, b, False)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON): one row for each host, inferred from all its pages. Null url: the empty host. Empty table: no rows."""

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Node] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = [(h, json.dumps(w.packed())) for h, w in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["host", "wrapper"])

        for b in batches:
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = parse(source)[0]
                size += nodes(page)
                if host in held:
                    held[host] = both(held[host], page)
                else:
                    held[host] = page
                if size > HELD_NODES and (size := sum(map(nodes, held.values()))) > HELD_NODES:
                    yield out()
                    size = 0
        if held:
            yield out()

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        first, *rest = sorted((Node.unpacked(json.loads(w)) for w in f["wrapper"]), key=lambda w: -w.pages)
        for w in rest:
            first = both(first, w)
        return pd.DataFrame({"host": [f["host"].iloc[0]], "wrapper": [json.dumps(first.packed())]})

    parts = materialize(pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(infer, "host string, wrapper string"))
    while (most := parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        order = Window.partitionBy("host").orderBy(F.xxhash64("wrapper"))
        dealt = parts.withColumn("_g", F.floor((F.row_number().over(order) - 1) / MERGE))
        parts = materialize(dealt.groupBy("host", "_g").applyInPandas(meet, "host string, wrapper string"))
        if most <= MERGE:
            break
    return parts


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text (the main text, empty if there is none) of every row of pages.

    Null html: empty. Null url: the pages without host share a wrapper. Repeated rows: each keeps its row. Very long
    pages are read whole, deeply nested ones to DEPTH levels of structure and with all their text. Clashing columns do
    not matter: only page_id, url and html are read. Empty table: no rows.
    """
    told = materialize(wrappers(pages))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([json.dumps(verdicts(Node.unpacked(json.loads(w)))) for w in b.column(1).to_pylist()], pa.string())], names=["host", "told"])

    told = materialize(told.mapInArrow(judge, "host string, told string"))
    bytes_ = told.agg(F.coalesce(F.sum(F.octet_length("told") + F.octet_length("host")), F.lit(0))).first()[0]
    if bytes_ <= BROADCAST_BYTES:
        told = F.broadcast(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list] = {}
        for b in batches:
            out = []
            for source, verdict in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if verdict is not None and verdict not in kept:
                    if len(kept) > 1000:
                        kept.clear()
                    kept[verdict] = json.loads(verdict)
                out.append(main_text(source, kept.get(verdict)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    joined = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(told, "host", "left")
    return joined.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "told").mapInArrow(run, "page_id long, url string, text string")
