"""Main text of HTML pages through wrappers inferred per host.

A wrapper is a union-free regular expression over a host's pages, kept as a tree: an element
with its children in order, some optional, some spans of them repeatable, and text leaves
that are either template text (the same on every page) or slots. It is inferred by aligning
one page after another: a child that the wrapper has further on makes what lies between
optional; one that repeats the children just seen makes a repeated group; any other becomes
a new optional child; differing text turns a leaf into a slot. Two wrappers align the same
way, so tasks infer their own pages' wrappers and only those are shuffled by host.

The wrapper then reads each page. Leaves under menus, headers, footers, sidebars, notices,
adverts, forms and comments are never main text: known by their tags and by class, role or id
values that name nothing else, in an article by few ids. Template text is none
either, in an article or out of it. On a page with an article or main element the other leaves
inside it are the text; on a page without one, all others, or of them those in blocks with a
class like 'content' if these hold most of the text.

NULL html is empty and gives an empty text. A NULL or odd url is a host of its own. Repeated
rows give repeated results. Extra columns are ignored, whatever their names. An empty table
gives no rows. A very long page is parsed whole; elements below 250 levels are no nodes of the
tree, but their text keeps its place and what their tags say of it. Of children with one label
the first that fits the order is matched.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm import store

# Elements that start a block, those without content, and those never shown.
BLOCKS = set(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody "
    "tfoot tr td th caption pre blockquote figure figcaption address hgroup details summary "
    "nav header footer aside form fieldset dialog menu center".split()
)
VOID = set("br hr img input meta link area base col embed source track wbr param".split())
RAW = "script style textarea title".split()  # no tags are read inside; unclosed ones hide the rest
HIDDEN = set(
    "noscript template select datalist button option svg math iframe object canvas video audio".split()
)
BOILERPLATE_TAGS = set("nav header footer aside form fieldset dialog menu".split())
BOILERPLATE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot sidebar "
    "sidenav aside widget cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe signup login search comment comments comentarios kommentare "
    "commentaires respond reply replies discussion disqus share sharing social related "
    "recommended recommendations pagination pager toolbar skip copyright legal".split()
)
# Words that may stand beside those in one class or role value: share-buttons, but not share-price.
BESIDE_WORDS = set(
    "area bar block body bottom box buttons button container form global icons inner item items left "
    "links list main message outer page panel posts primary right secondary section site slot "
    "social text thread title top unit wrap wrapper".split()
)
# Within an article only these ids are boilerplate; others are often made from a heading's text.
BOILERPLATE_IDS = set(
    "comments comentarios kommentare commentaires respond disqus disqus-thread comment-list sidebar "
    "navbar breadcrumbs newsletter cookie-notice share-buttons".split()
)
TEXT_TAGS = set("h1 h2 h3 h4 h5 h6 p li dt dd td th caption blockquote pre figcaption".split())
MAIN_TAGS = {"article", "main"}
MAIN_WORDS = set("article content main post story entry maincontent articlebody".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
SAME_ON = 5  # different pages that must agree before a text counts as template

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
    r"(?:.*?</(?P=raw)(?=[\s/>])[^>]*>|.*\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


DEPTH = 250  # levels of a tree; it is walked by recursion


class Node:
    """An element or, with label '#', a text leaf."""

    __slots__ = ("label", "kids", "optional", "loops", "text", "pages", "seen", "role")

    def __init__(self, label: str, text: str | None = None):
        self.label, self.text, self.pages = label, text, 1
        self.seen: set[int] = set()  # a leaf's distinct pages, SAME_ON of them at most
        self.kids: list[Node] = []
        self.optional, self.loops, self.role = False, set(), ""

    def dump(self) -> list:
        loops = sorted(map(list, self.loops))
        kids = [k.dump() for k in self.kids]
        return [self.label, self.text, self.pages, self.optional, loops, kids, sorted(self.seen)]

    @classmethod
    def load(cls, value: list) -> Node:
        node = cls(value[0], value[1])
        node.pages, node.optional = value[2], value[3]
        node.loops = {tuple(x) for x in value[4]}
        node.kids = [cls.load(k) for k in value[5]]
        node.seen = set(value[6])
        return node

    def expression(self) -> str:
        """The wrapper as a regular expression, for people."""
        if self.label == "#":
            return "#TEXT" if self.text is None else repr(self.text)
        parts = [k.expression() + ("?" if k.optional else "") for k in self.kids]
        for lo, hi in sorted(self.loops, key=lambda x: x[1] - x[0]):
            parts[lo] = "(" + parts[lo]
            parts[hi] += ")+"
        return f"<{self.label}>{' '.join(parts)}</>"


def label_of(name: str, rest: str) -> str:
    """Element name and the words of its class, id and role."""
    words: set[str] = set()
    for m in ATTRIBUTE.finditer(rest):
        words.update(re.findall(r"[a-z]+", (m[2] or m[3] or m[4] or "").lower()))
    return " ".join([name, *sorted(words)])


def boilerplate(value: str) -> bool:
    """Whether all words of one class, role or id name menus, adverts, comments and the like."""
    words = set(re.findall(r"[^\W_]+", value))
    if "header" in words and not words & (BOILERPLATE_WORDS - {"header"}):
        return words <= {"header", "site", "page", "global", "main", "top"}  # others head a section
    return bool(words & BOILERPLATE_WORDS) and words <= BOILERPLATE_WORDS | BESIDE_WORDS


@lru_cache(4096)
def role_of(name: str, rest: str) -> str:
    """'skip', 'skip outside' (of articles), 'main', 'maybe' (a class says so) or '' for an element."""
    if name in BOILERPLATE_TAGS:
        return "skip"
    values, ids = [], []
    for m in ATTRIBUTE.finditer(rest):
        (ids if m[1].lower() == "id" else values).extend((m[2] or m[3] or m[4] or "").lower().split())
    if name in MAIN_TAGS:
        return "skip" if any(map(boilerplate, values)) else "main"
    if any(map(boilerplate, values)):
        return "skip"
    if name not in TEXT_TAGS:
        if any(i.replace("_", "-") in BOILERPLATE_IDS for i in ids):
            return "skip"
        if any(map(boilerplate, ids)):
            return "skip outside"
    return "maybe" if any(MAIN_WORDS.intersection(re.findall(r"[a-z]+", v)) for v in values + ids) else ""


def named(token: re.Match) -> tuple[str, str, bool]:
    """(name, attributes, end tag?) of a tag; other tokens have no name."""
    name = (token["name"] or token["name2"] or "").lower()
    return name, token["rest"] or token["rest2"] or "", bool(token["close"] or token["close2"])


def hidden_spans(tags: list[tuple[str, str, bool]]) -> dict[int, int]:
    """For the first token of each hidden element, the token up to which it hides.

    Without its end tag that is the next block's tag, for an option also the next option.
    """
    spans: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    options: set[int] = set()
    others: set[int] = set()
    for i, (name, rest, closing) in enumerate(tags):
        block = name in BLOCKS
        if block or name in ("option", "optgroup", "select", "datalist"):
            spans.update(dict.fromkeys(options, i))
            options.clear()
            opened.pop("option", None)
        if block:
            spans.update(dict.fromkeys(others, i))  # its end tag, if one comes, widens this
            others.clear()
        if name not in HIDDEN:
            continue
        if closing:
            if opened.get(name):
                first = opened[name].pop()
                spans[first] = i
                options.discard(first)
                others.discard(first)
        elif not (name in ("svg", "math") and rest.endswith("/")):
            opened.setdefault(name, []).append(i)
            (options if name == "option" else others).add(i)
            spans[i] = len(tags)
    return spans


def parse(page: str) -> Node:
    """The tree of a page's blocks; every leaf holds one block's text."""
    root = Node("page")
    stack, parts, at = [root], [], 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            # Elements below DEPTH are no nodes: their text joins the last node above in page
            # order, inside one node for each role that they gave it.
            at = stack[: DEPTH][-1]
            for role in dict.fromkeys(n.role for n in stack[DEPTH:] if n.role):
                at.kids.append(Node("deep"))
                at = at.kids[-1]
                at.role = role
            at.kids.append(Node("#", text))

    def close(names: set[str], until: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            own = stack[i].label.split(" ", 1)[0]
            if own in names:
                flush()
                del stack[i:]
                return
            if own in until:
                return

    tokens = list(TOKEN.finditer(page))
    tags = list(map(named, tokens))
    spans, until = hidden_spans(tags), -1
    for i, (m, (name, rest, closing)) in enumerate(zip(tokens, tags)):
        if i > until:
            parts.append(page[at : m.start()])
        at = m.end()
        until = max(until, spans.get(i, -1))
        if i < until or not name or name in HIDDEN:
            continue
        if name in VOID:
            parts.append(" ")
            if name == "hr":
                flush()
            continue
        known = name in BLOCKS
        if not closing and not known:
            known = role_of(name, rest) == "skip" and name not in ("a", "b", "i", "em", "strong")
        if not known and not (closing and any(n.label.split(" ", 1)[0] == name for n in stack)):
            continue
        if closing:
            close({name}, set())
            continue
        flush()
        close({"p"}, {"div", "article", "section", "td", "li", "main"})
        if name in CLOSED_BY:
            close(CLOSED_BY[name], {"ul", "ol", "dl", "table"})
        if name in ("html", "body"):
            continue
        node = Node(label_of(name, rest))
        node.role = role_of(name, rest)
        if len(stack) < DEPTH:
            stack[-1].kids.append(node)
        stack.append(node)
    if until < len(tokens):
        parts.append(page[at:])
    flush()
    return root


def align(wrapper: Node, other: Node, new: bool = False) -> None:
    """Generalise ``wrapper`` so that it also covers ``other``.

    The children of a ``new`` wrapper are on all its pages so far, so none becomes optional.
    """
    wrapper.pages += other.pages
    wrapper.optional |= other.optional
    if wrapper.label == "#":
        if wrapper.text != other.text:
            wrapper.text = None
        seen = wrapper.seen | other.seen if wrapper.text is not None else ()
        wrapper.seen = set(sorted(seen)[:SAME_ON])
        return
    kids, cursor, spots = wrapper.kids, 0, []
    met = [False] * len(kids)

    def put(at: int, node: Node) -> None:
        kids.insert(at, node)
        met.insert(at, True)
        moved = {(a + (a >= at), b + (b >= at)) for a, b in wrapper.loops}
        wrapper.loops.clear()
        wrapper.loops.update(moved)
        spots[:] = [s + (s >= at) for s in spots]

    labels = [k.label for k in other.kids]
    for pos, kid in enumerate(other.kids):
        ahead = next((i for i in range(cursor, len(kids)) if kids[i].label == kid.label), None)
        back = next((i for i in range(cursor - 1, -1, -1) if kids[i].label == kid.label), None)
        square = [k.label for k in kids[back:cursor]] if back is not None else []
        again = bool(square) and (len(square) == 1 or labels[pos : pos + len(square)] == square)
        if again or (back is not None and any(a <= back <= b for a, b in wrapper.loops)):
            if again:
                wrapper.loops.add((back, cursor - 1))
            spot = back
        elif ahead is not None:
            spot = ahead
        else:
            spot = cursor
            fresh = Node(kid.label, kid.text)
            fresh.pages = 0
            align(fresh, kid, new=True)
            fresh.optional = kid.optional or not new
            put(spot, fresh)
            spots.append(spot)
            cursor = spot + 1
            continue
        align(kids[spot], kid)
        if met[spot]:
            kids[spot].pages -= kid.pages  # a repetition is not another page
            if kids[spot].label == "#":
                kids[spot].text = None
        met[spot] = True
        spots.append(spot)
        cursor = spot + 1
    for a, b in other.loops:
        if a < len(spots) and b < len(spots) and spots[a] <= spots[b]:
            wrapper.loops.add((spots[a], spots[b]))
    for kid, seen in zip(kids, met):
        if not seen:
            kid.optional = True


def sign(page: Node) -> None:
    """Mark the leaves with a hash of the page's readable text, so that copies count as one page.

    Pages of different readable text differ in other leaves than those they agree on.
    """
    leaves: list[Node] = []
    texts: list[str] = []

    def walk(node: Node, shown: bool) -> None:
        for kid in node.kids:
            if kid.label == "#":
                leaves.append(kid)
                if shown:
                    texts.append(kid.text)
            else:
                walk(kid, shown and not kid.role.startswith("skip"))

    walk(page, True)
    mark = xxhash.xxh64_intdigest("\n".join(texts).encode("utf-8", "surrogatepass"))
    for leaf in leaves:
        leaf.seen = {mark}


def induce(pages: Iterator[Node]) -> Node | None:
    wrapper = None
    for page in pages:
        sign(page)
        new = wrapper is None
        if new:
            wrapper = Node("page")
            wrapper.pages = 0
        align(wrapper, page, new)
    return wrapper


def read(wrapper: Node | None, page: Node) -> str:
    """The blocks of main text of a page, as the wrapper labels them."""
    inside: list[str] = []  # of article and main elements
    maybe: list[str] = []  # of blocks whose class or id says so
    every: list[str] = []

    def walk(own: Node | None, node: Node, main: bool, named: bool) -> None:
        cursor = 0
        for kid in node.kids:
            match = None
            if own is not None:
                order = [*range(cursor, len(own.kids)), *range(cursor - 1, -1, -1)]
                spot = next((i for i in order if own.kids[i].label == kid.label), None)
                if spot is not None:
                    match, cursor = own.kids[spot], spot
            if kid.label == "#":
                fixed = match is not None and match.text == kid.text and len(match.seen) >= SAME_ON
                if fixed:
                    continue
                if main:
                    inside.append(kid.text)
                else:
                    every.append(kid.text)
                    if named:
                        maybe.append(kid.text)
                continue
            if kid.role != "skip" and (main or kid.role != "skip outside"):
                walk(match, kid, main or kid.role == "main", named or kid.role == "maybe")

    walk(wrapper, page, False, False)
    # A class or id decides only where it holds most of the text.
    if 2 * sum(map(len, maybe)) < sum(map(len, every)):
        maybe = every
    return "\n\n".join(inside or maybe)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def infer(pages: DataFrame, spread: int = 32) -> DataFrame:
    """(host, wrapper): one wrapper per host over all of its pages."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[str, list[str]] = {}
            for url, page in zip(batch["url"].to_pylist(), batch["html"].to_pylist()):
                own.setdefault(host_of(url), []).append(page or "")
            made = [json.dumps(induce(map(parse, p)).dump()) for p in own.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(made, pa.string())], ["host", "wrapper"])

    def combine(table: pa.Table) -> pa.Table:
        parts = (Node.load(json.loads(w)) for w in sorted(table["wrapper"].to_pylist()))
        whole = next(parts)
        for part in parts:
            align(whole, part)
        return pa.table({"host": [table["host"][0].as_py()], "wrapper": [json.dumps(whole.dump())]})

    schema = "host string, wrapper string"
    parts = pages.select("url", "html").mapInArrow(partial, schema)
    # A host with a large share of the pages is first combined in ``spread`` groups.
    some = parts.groupBy("host", (F.xxhash64("wrapper") % spread).alias("salt")).applyInArrow(combine, schema)
    return some.groupBy("host").applyInArrow(combine, schema)


def extract(pages: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(page_id, url, text) of every page."""
    wrappers = store.keep(infer(pages), "wrappers")

    def host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = [host_of(u) for u in batch["url"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hosts, pa.string())], [*batch.schema.names, "host"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, Node] = {}
        for batch in batches:
            texts = []
            for page, value, own in zip(*(batch[c].to_pylist() for c in ("html", "wrapper", "host"))):
                if own not in loaded:
                    if len(loaded) > 1000:
                        loaded.clear()
                    loaded[own] = Node.load(json.loads(value)) if value else None
                texts.append(read(loaded[own], parse(page or "")))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    size = wrappers.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()[0]
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    named = rows.mapInArrow(host, "page_id long, url string, html string, host string")
    # Past the bound the join shuffles, and splits a hot host's partition.
    side = F.broadcast(wrappers) if size <= broadcast_bytes else wrappers
    joined = named.join(side, "host", "left").select("page_id", "url", "html", "host", "wrapper")
    return joined.mapInArrow(run, "page_id long, url string, text string")
