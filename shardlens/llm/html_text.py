"""Main text of web pages by tree scoring (operator 2).

A page becomes a tree of block elements; menus, forms, scripts, notices and the like are left out as they are
met. Every paragraph earns points for its length and its commas and passes them to its ancestors (all to the
parent, half to the grandparent, a third of that on each further level). Containers lose points by the share of
their text that stands in links. The best container is kept together with the siblings that score well enough
or hold prose; a container inside an ``article`` or ``main`` stands for that whole element.

Within a block white space becomes one space; blocks are joined in page order by an empty line. Character
references are decoded. Nothing is cut or capped. A column expression over Arrow batches, no shuffle.

Defined results: null, empty and text-free pages give the empty text; unclosed and stray tags are taken as
browsers take them (a block closes an open paragraph); an unfinished tag at the end is dropped; a page without
any element is its own text; pages whose every container is empty of points give the whole remaining body.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from shardlens.llm.common import table

#: Elements of HTML by the part they play.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
DROPPED = RAW | frozenset("head nav header footer aside form button select option fieldset menu dialog object applet canvas "
                          "audio video map label legend datalist".split())
PARAGRAPHS = frozenset("p pre td th li dd dt blockquote h1 h2 h3 h4 h5 h6 figcaption caption summary address".split())
CONTAINERS = frozenset("html body div section article main table thead tbody tfoot tr ul ol dl figure details center hgroup".split())
BLOCKS = PARAGRAPHS | CONTAINERS
#: An opening tag of the key closes an open element of the value.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words in class, id or role that mark an element as something other than the article.
SIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar "
                       "navigation breadcrumb breadcrumbs sidebar aside widget header masthead footer colophon notice alert cookie "
                       "cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social "
                       "comment comments commentlist disqus reply replies related recommended recommendations pagination pager "
                       "toolbar complementary contentinfo search skip disclaimer paywall".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(>|\Z)", re.S)
_MARKS = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
LEAST_PARAGRAPH = 25
MOST_LENGTH_POINTS = 3.0
FURTHEST = 9  # ancestors further up would get less than a thousandth of the points
SEMANTIC = {"article": 10.0, "main": 10.0, "section": 3.0, "div": 3.0}


class _Node:
    __slots__ = ("tag", "parent", "parts", "score", "text", "links")

    def __init__(self, tag: str, parent: _Node | None):
        self.tag, self.parent, self.parts = tag, parent, []
        self.score, self.text, self.links = 0.0, 0, 0


def _is_side(attributes: str) -> bool:
    for m in _MARKS.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif name in ("class", "id", "role") and not SIDE_WORDS.isdisjoint(w.lower() for w in _WORDS.findall(value)):
            return True
    return False


def parse(page: str) -> _Node:
    """The tree of what isn't dropped: parts are texts (with a flag for text in links), ``None`` for a line break, and nodes."""
    root = node = _Node("root", None)
    open_tags: list[tuple[str, _Node | None]] = []  # inline elements have no node of their own
    skipping: list[str] = []  # the dropped element and what is open inside it
    in_link, at, end = 0, 0, len(page)
    raw_until = None

    def put(text: str) -> None:
        if text and not skipping:
            node.parts.append((text, in_link > 0))

    def close_to(index: int) -> None:
        nonlocal node, in_link
        for tag, own in reversed(open_tags[index:]):
            if own is not None:
                node = own.parent
            elif tag == "a":
                in_link = max(0, in_link - 1)
        del open_tags[index:]

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at:m.start()])
        at = m.end()
        if m[1] is not None:
            put(m[1])
        if m[3] is None:
            continue
        if not m[5]:  # the page ends inside a tag
            break
        tag = m[3].lower()
        if m[2]:
            if skipping:
                if tag in skipping:
                    while skipping.pop() != tag:
                        pass
                elif any(tag == t for t, _ in open_tags) and tag in CONTAINERS:  # an outer element ends
                    skipping.clear()
            if not skipping:
                index = next((i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i][0] == tag), None)
                if index is not None and not (tag not in BLOCKS and any(own is not None for _, own in open_tags[index + 1:])):
                    close_to(index)
            continue
        closed = tag in VOID or m[4].rstrip().endswith("/") and tag in RAW
        if tag in RAW and not closed:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = page.find(">", stop.start()) + 1 or end if stop else end
            continue
        if skipping:
            if not closed:
                skipping.append(tag)
            continue
        if tag == "body":  # a head that was never closed ends here
            skipping.clear()
        if closed:
            if tag in ("br", "hr", "wbr") and tag != "wbr":
                node.parts.append(None if tag == "br" else _Node("hr", node))
            continue
        if tag in BLOCKS or tag in DROPPED:
            index = next((i for i in range(len(open_tags) - 1, -1, -1)
                          if open_tags[i][0] == "p" or open_tags[i][1] is not None and open_tags[i][0] in CONTAINERS), None)
            if index is not None and open_tags[index][0] == "p":
                close_to(index)
            for name in CLOSES.get(tag, ()):
                index = next((i for i in range(len(open_tags) - 1, -1, -1)
                              if open_tags[i][0] == name or open_tags[i][0] in ("ul", "ol", "dl", "table")), None)
                if index is not None and open_tags[index][0] == name:
                    close_to(index)
        if tag in DROPPED or _is_side(m[4]) and tag not in ("html", "body", "article", "main"):
            skipping.append(tag)
        elif tag in BLOCKS:
            child = _Node(tag, node)
            node.parts.append(child)
            node = child
            open_tags.append((tag, child))
        else:
            in_link += tag == "a"
            open_tags.append((tag, None))
    return root


def _own_text(node: _Node) -> str:
    return "".join(" " if p is None else p[0] for p in node.parts if not isinstance(p, _Node))


def _measure(root: _Node) -> list[_Node]:
    """All nodes in page order, with their text and link lengths, and the points passed up from paragraphs."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(p for p in reversed(node.parts) if isinstance(p, _Node))
    for node in order:
        node.score = SEMANTIC.get(node.tag, 0.0)
        for p in node.parts:
            if isinstance(p, tuple):
                n = len(p[0].strip())
                node.text += n
                node.links += n if p[1] else 0
    for node in reversed(order):
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.links += node.links
    for node in order:
        text = _own_text(node).strip()
        if len(text) < LEAST_PARAGRAPH or node.tag not in PARAGRAPHS and node.tag not in CONTAINERS:
            continue
        points = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, MOST_LENGTH_POINTS)
        up, level = (node.parent, 1) if node.tag in PARAGRAPHS and node.parent is not None else (node, 1)
        while up is not None and level <= FURTHEST:
            up.score += points / (1 if level == 1 else 2 if level == 2 else 2 * 3 ** (level - 2))
            up, level = up.parent, level + 1
    for node in order:
        node.score *= 1 - node.links / node.text if node.text else 0.0
    return order


def _main(root: _Node) -> list[_Node]:
    containers = [n for n in _measure(root) if n.tag in CONTAINERS and n.tag not in ("html", "body") or n.parent is None]
    best = max(containers, key=lambda n: n.score)  # the first of equals
    if best.parent is None or best.score <= 0:
        return [root]
    up = best
    while up.parent is not None:
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.parent
    kept = []
    for sibling in (p for p in best.parent.parts if isinstance(p, _Node)):
        density = sibling.links / sibling.text if sibling.text else 1.0
        prose = sibling.tag in PARAGRAPHS and density < 0.25 and (sibling.text > 80 or re.search(r"[.!?…。](\s|$)", _own_text(sibling)))
        if sibling is best or best.tag not in ("article", "main") and (
                sibling.tag in CONTAINERS and sibling.score >= max(10.0, 0.2 * best.score) or prose):
            kept.append(sibling)
    return kept


def _blocks(nodes: list[_Node]) -> list[str]:
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            blocks.append(text)

    stack: list = list(reversed(nodes))
    while stack:
        part = stack.pop()
        if isinstance(part, _Node):
            flush()
            stack.append(flush)
            stack.extend(reversed(part.parts))
        elif part is None:
            run.append(" ")
        elif callable(part):
            part()
        else:
            run.append(part[0])
    flush()
    return blocks


def main_text(page: str | None) -> str:
    """The article of one page."""
    return "\n\n".join(_blocks(_main(parse(page)))) if page else ""


def extract(page: Column) -> Column:
    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p) for p in pages], dtype=object)

    return texts(page.cast("string"))


def op2_tree_scored_html(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", extract(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))
