"""Main text of web pages by composite text density.

The page is parsed to a tree of block elements and of runs of inline content.
Every node gets a link-adjusted density: characters per tag, damped by the share
of characters and tags inside links, relative to the body's.  The node whose
children's densities have the greatest sum, names of tags and classes aside, is
the middle of the article.  The least density on its path up to the body is the
threshold: what else hangs on that path joins it if it has half of that density and
half of the sum, so that short or thin neighbours stay out.

Names that mark parts around an article (menus, adverts ...) take these parts
out of what was chosen.  They overrule the choice itself only where it lies in
such a part, and a layout name such as ``sidebar`` doesn't where it would take
most of the page's unlinked text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame

#: Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Never text of a page.
NEVER = RAW | frozenset("head noscript template object canvas svg math button select option datalist label audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var".split()
)
#: Elements that hold one paragraph or the like; the article is what holds several.
PIECE = frozenset("p li dt dd td th tr h1 h2 h3 h4 h5 h6 pre blockquote figcaption address caption summary".split())
SCOPE = frozenset("body article section div table ul ol dl td th main aside nav blockquote form figure header footer".split())
ENDS_P = SCOPE | frozenset("p pre hr h1 h2 h3 h4 h5 h6 address details dialog fieldset figcaption hgroup menu search".split()) - {"td", "th", "body"}
#: A new one of these ends an open one of its family in the same scope.
CLOSES = {"p": ("p",), "li": ("li",), "tr": ("tr",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}

#: Around an article by tag: never part of it, and not part of it unless most text is there.
AROUND_TAGS, LAYOUT_TAGS = frozenset("nav menu dialog".split()), frozenset("header footer aside form fieldset".split())
#: The same by the words of class, id and role.
AROUND_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored nav navbar navigation menu menus breadcrumb "
    "breadcrumbs share sharing social cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login comment "
    "comments disqus respond replies pagination pager toolbar skip".split()
)
LAYOUT_WORDS = frozenset(
    "header masthead footer foot sidebar side aside widget widgets related recommended promo promotion promotions banner notice notices "
    "overlay search copyright legal contentinfo complementary dialog".split()
)
#: Words that say nothing about a part, beside one that does: ``site-header``, ``ad_slot_2``.
PLAIN_WORDS = frozenset(
    "site page global main primary secondary top bottom left right upper lower inner outer box bar area list links link item items wrapper wrap "
    "container holder section block unit slot group row col column panel post posts stories articles buttons button icons form reader user "
    "google text js module inline sticky fixed".split()
)
#: What joins the densest subtree has at least this share of the threshold and of its sum; an ``article`` stands for it from this share of its density on.
LEAST_SHARE = 0.5
#: A layout name is overruled where the rest of the page holds less than this share of the unlinked characters.
LEAST_LEFT = 0.2

TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*+)"
    r"(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S,
)
ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)


class Node:
    """A block element, or (name ``#run``) a run of inline content; ``tags`` counts elements inside, itself included."""

    __slots__ = ("chars", "density", "kind", "link_chars", "link_tags", "name", "parent", "parts", "tags", "text", "total")

    def __init__(self, name: str, parent: Node | None, kind: int = 0):
        self.name, self.parent, self.kind, self.parts, self.text = name, parent, kind, [], []
        self.chars = self.link_chars = self.link_tags = 0
        self.tags = 0 if name[0] == "#" else 1
        self.density = self.total = 0.0


def kind_of(name: str, attrs: str) -> int:
    """2 for a part around an article, 1 for a part of the layout, else 0."""
    kind = 2 if name in AROUND_TAGS else 1 if name in LAYOUT_TAGS else 0
    if not attrs or name in ("body", "html", "article", "main"):
        return kind
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return 2
        if key in ("class", "id", "role"):
            for token in value.split():
                words = {w for w in re.split(r"[-_\d]+", token) if w}
                if words <= AROUND_WORDS | LAYOUT_WORDS | PLAIN_WORDS:
                    kind = max(kind, 2 if words & AROUND_WORDS else 1 if words & LAYOUT_WORDS else 0)
    return kind


class Parser:
    def __init__(self, html: str):
        self.html, self.root = html, Node("#root", None)
        self.stack: list[tuple[str, Node, bool]] = []  # name, block that it opened or is in, skipped
        self.scopes: list[dict[str, int]] = [{}]  # open elements by name, since the innermost of SCOPE
        self.open: dict[str, int] = {}
        self.block, self.run, self.skipped, self.links = self.root, None, 0, 0

    def push(self, name: str, node: Node, skipped: bool) -> None:
        self.stack.append((name, self.block, skipped))
        self.open[name] = self.open.get(name, 0) + 1
        if name in SCOPE:
            self.scopes.append({})
        else:
            self.scopes[-1][name] = self.scopes[-1].get(name, 0) + 1
        self.block = node
        self.skipped += skipped
        self.links += name == "a"

    def pop(self) -> str:
        name, before, skipped = self.stack.pop()
        self.open[name] -= 1
        if name in SCOPE:
            self.scopes.pop()
        else:
            self.scopes[-1][name] -= 1
        if self.block is not before:
            self.run = None
        self.block = before
        self.skipped -= skipped
        self.links -= name == "a"
        return name

    def close(self, name: str) -> None:
        while self.pop() != name:
            pass

    def here(self) -> Node:
        if self.run is None:
            self.run = Node("#run", self.block)
            self.block.parts.append(self.run)
        return self.run

    def tree(self) -> Node:
        html, at, n = self.html, 0, len(self.html)
        while at < n:
            m = TAG.search(html, at)
            text = html[at : m.start()] if m else html[at:]
            if text and not self.skipped:
                text = unescape(text)
                run, size = self.here(), len("".join(text.split()))
                run.text.append(text)
                run.chars += size
                if self.links:
                    run.link_chars += size
            if m is None:
                break
            at = m.end()
            if m["name"] and (at < n or html[-1] == ">"):
                (self.end if m["end"] else self.start)(m["name"].lower(), m["attrs"])
                if not m["end"] and m["name"].lower() in RAW:
                    close = re.compile(rf"</{re.escape(m['name'])}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(html, at)
                    at = close.end() if close else n
        return self.root

    def end(self, name: str, _: str) -> None:
        if (self.open if name in SCOPE else self.scopes[-1]).get(name):
            self.close(name)
        elif name == "br":
            self.run = None

    def start(self, name: str, attrs: str) -> None:
        if self.open.get("head") and name not in IN_HEAD and self.stack[-1][0] == "head":
            self.pop()  # what can't be in a head ends it
        if name in ("html", "body") and self.open.get(name):
            return
        if name in ENDS_P and self.scopes[-1].get("p"):
            self.close("p")
        if name in ("td", "th", "tr"):
            last = next((x[0] for x in reversed(self.stack) if x[0] in SCOPE), None)
            if last in ("td", "th"):
                self.close(last)
        for other in CLOSES.get(name, ()):
            if self.scopes[-1].get(other):
                self.close(other)
        if name in RAW:
            return
        if name in VOID:
            if name in ("br", "hr"):
                self.run = None
            return
        kind = 0 if self.skipped else kind_of(name, attrs)
        if attrs.endswith("/") and name not in SCOPE and name not in INLINE and name not in ENDS_P:
            return  # an element of svg and the like without content
        if name in NEVER or name in INLINE:
            if name not in ("noscript", "template", "head", "svg", "math") and name in NEVER:
                self.run = None
            if name in INLINE and not self.skipped:
                run = self.here()
                run.tags += 1
                run.link_tags += name == "a"
            self.push(name, self.block, name in NEVER or kind == 2)
            return
        node = Node(name, self.block, kind)
        self.block.parts.append(node)
        self.push(name, node, False)
        self.run = None


def parse(html: str) -> Node:
    return Parser(html).tree()


def up(node: Node) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def order_of(root: Node, barred: int = 3) -> list[Node]:
    """The nodes in page order, without those of kind ``barred`` or more and what is in them."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo.extend(p for p in reversed(x.parts) if p.kind < barred)
    return out


def composite(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, damped by links; ``share`` is that of the body's characters which are in links."""
    if not chars:
        return 0.0
    tags, links = max(tags, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    return chars / tags * max(math.log(max(chars / max(link_chars, 1) * tags / links, 1.0)) / base, 0.0)


def measure(root: Node) -> Node:
    """Fills counts, densities and the sums of children's densities; returns the body, or the root without one."""
    order = order_of(root)
    for x in reversed(order):  # children before parents
        for p in x.parts:
            x.chars, x.tags = x.chars + p.chars, x.tags + p.tags
            x.link_chars, x.link_tags = x.link_chars + p.link_chars, x.link_tags + p.link_tags
    body = next((x for x in order if x.name == "body"), root)
    share = body.link_chars / max(body.chars, 1)
    for x in reversed(order):
        x.density = composite(x.chars, x.tags, x.link_chars, x.link_tags, share)
        x.total = sum(p.density for p in x.parts)
    return body


def densest(nodes: list[Node]) -> Node | None:
    """The node with the greatest sum; of equal ones the one with more text, then the first."""
    return max((x for x in nodes if x.name != "#run" and x.chars), key=lambda x: (x.total, x.chars), default=None)


def unlinked(nodes: list[Node]) -> int:
    return sum(x.chars - x.link_chars for x in nodes if x.name == "#run")


def named_against(node: Node) -> bool:
    return any(x.kind for x in up(node))


def select(root: Node) -> list[Node]:
    """The nodes whose text is the article, in page order; what is around an article is taken out of them by ``runs``."""
    body = measure(root)
    best = densest(order_of(body))
    if best is not None and named_against(best):  # densities and names disagree: names decide, unless they would leave too little
        strict, free = order_of(body, 1), order_of(body, 2)
        best = densest(strict)
        if unlinked(strict) < LEAST_LEFT * unlinked(free):
            best = densest(free)
            for x in up(best):
                x.kind = 0  # most of the text is inside: the names on the way there mean the layout, not the content
    if best is None:
        return []
    path = list(up(best))
    below = [x for x in path if x is not body and x.name != "#root"] or [body]
    threshold = min(x.density for x in below)
    # a paragraph stands for what holds it, and a part of an article for the article, if that is not much thinner
    top = next((x for x in path if x.name not in PIECE), best)
    for name in ("main", "article"):
        top = next((x for x in reversed(path) if x.name == name and x.density >= LEAST_SHARE * best.density), top)
    path = set(path[path.index(top) :])
    chosen, todo = [], [body]
    while todo:
        x = todo.pop()
        if x is top:
            chosen.append(x)
        elif x in path:
            todo.extend(reversed(x.parts))
        elif x.kind == 0 and x.chars and x.density >= LEAST_SHARE * threshold and x.total >= LEAST_SHARE * best.total:
            chosen.append(x)
    return chosen


def menu_like(x: Node) -> bool:
    """A list or division of three links or more and nothing else."""
    return x.name in ("ul", "ol", "div", "section", "table") and x.link_tags >= 3 and x.chars == x.link_chars


def runs(nodes: list[Node]) -> Iterator[Node]:
    todo = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x.name == "#run":
            yield x
        elif not menu_like(x):
            todo.extend(p for p in reversed(x.parts) if p.kind == 0 or p.kind == 1 and p.name == "header" and heads(p))


def heads(x: Node) -> bool:
    """Whether a header inside of what was chosen holds a heading, so that it belongs to the article."""
    return any(p.name in ("h1", "h2", "h3", "hgroup") for p in x.parts) and any(y.name in ("article", "main", "section") for y in up(x))


def main_text(html: str | None) -> str:
    """The article's text of one page; empty for null, empty or text-free pages."""
    if not isinstance(html, str) or not html:
        return ""
    blocks = (" ".join("".join(x.text).split()) for x in runs(select(parse(html))))
    return " ".join(b for b in blocks if b)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars (code points).

    Null html gives an empty text; repeated rows are extracted one by one;
    null ids and urls stay null; other columns are ignored; no rows give none.
    Of equal density sums the subtree with more text, then the first, counts.
    Pages are worked on one at a time and in one pass, so time and memory
    follow their length, however long; a tag that never ends takes the rest.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(x) for x in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": [len(x) for x in text]})

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
