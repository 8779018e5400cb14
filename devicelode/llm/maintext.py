"""The main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelode.llm.common import small_batches

# Names of HTML elements by what they mean for a page's text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("head nav header footer aside button select option optgroup datalist fieldset label legend menu dialog object applet audio video canvas svg math map".split()) | RAW
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
CLOSED_BY = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset("tr td th".split()),
             "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tbody": frozenset("tbody thead tfoot tr td th".split()),
             "tfoot": frozenset("tbody thead tfoot tr td th".split()), "option": frozenset(["option"])}
CELLS = frozenset("tr td th tbody tfoot".split())
CELL_SCOPES, ITEM_SCOPES = frozenset(["table"]), frozenset("ul ol dl select table".split())
SCOPES = frozenset("ul ol dl table td th select body html article main section div nav aside header footer form".split())
PARAGRAPH, PARAGRAPH_SCOPES = frozenset(["p"]), SCOPES | {"li"}
WHOLE = frozenset(["", "html", "body"])
GROUPS = frozenset("html body main article section div td center form".split()) | {""}
# Words of classes, ids and roles of parts that aren't the article.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices "
                  "alert alerts popup modal overlay newsletter subscribe subscription signup login register sidebar aside nav navbar navigation navi menu menus submenu breadcrumb "
                  "breadcrumbs footer masthead header topbar toolbar comment comments disqus respond replies reply discussion share sharing social related recommended "
                  "recommendations pagination pager paging widget widgets search skip complementary contentinfo form".split())
LOOSE = frozenset("has no not with without open close closed show hide is single".split())

TOKEN = re.compile(r"""[^<]+|<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>=]++|=\s*(?:"[^"]*"|'[^']*')|["'=])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
NAME = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？؟،।]")


@dataclass(slots=True)
class Node:
    """One element: its parent, its tag path (a number), and whether it is a part that never holds the article."""
    tag: str
    parent: int
    path: int
    unseen: bool
    marked: bool
    inside: bool


@dataclass(slots=True)
class Block:
    """Text between two block boundaries: the element around it, its tag path, and how much of it stands in links."""
    node: int
    path: int
    parts: list = field(default_factory=list)
    linked: int = 0
    inner: set = field(default_factory=set)
    text: str = ""


def marked(attributes: str) -> tuple[bool, bool]:
    """(by class, id or role no part of the article, not shown at all)."""
    by_name = unseen = False
    for name, one, two, three, bare in ATTRIBUTE.findall(attributes):
        name, value = (name or bare).lower(), html.unescape(one or two or three)
        if name in ("class", "id", "role"):
            for word in value.split():
                parts = [p.lower() for p in NAME.findall(word)]
                by_name = by_name or bool(parts) and parts[0] not in LOOSE and (parts[0] in MARKS or parts[-1] in MARKS)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            unseen = True
    return by_name, unseen


def parsed(page: str) -> tuple[list[Node], list[Block]]:
    """All elements and blocks of a page in one pass; open paragraphs, items and cells end where HTML lets them end."""
    nodes, blocks = [Node("", -1, 0, False, False, False)], []
    paths: dict[tuple[int, str], int] = {}
    stack, block, links, at = [0], None, 0, 0

    def flush() -> None:
        nonlocal block
        if block is not None and (text := " ".join(html.unescape("".join(block.parts)).split())):
            block.text = text
            if len(block.inner) == 1:
                block.path = block.inner.pop()
            blocks.append(block)
        block = None

    def pop(size: int) -> None:
        nonlocal links
        links -= sum(nodes[k].tag == "a" for k in stack[size:])
        del stack[size:]

    def close(names: frozenset, scopes: frozenset) -> None:
        for i in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[i]].tag
            if tag in names:
                pop(i)
                return
            if tag in scopes:
                return

    while at < len(page):
        found = TOKEN.match(page, at)
        at = found.end()
        ending, tag, attributes = found.groups()
        if tag is None:
            token = found.group()
            top = nodes[stack[-1]]
            if top.unseen or token[0] == "<" and len(token) > 1:
                continue
            if block is None:
                inner = next(k for k in reversed(stack) if nodes[k].tag not in INLINE)
                block = Block(inner, nodes[inner].path)
            block.parts.append(token)
            if not token.isspace():
                block.inner.add(top.path)
                block.linked += len(token) if links else 0
            continue
        tag = tag.lower()
        if tag == "br":
            if block is not None:
                block.parts.append(" ")
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        if ending:
            i = len(stack) - 1
            while i and nodes[stack[i]].tag != tag and not (inline and nodes[stack[i]].tag not in INLINE):
                i -= 1
            if i and nodes[stack[i]].tag == tag:
                pop(i)
            continue
        if tag in VOID:
            continue
        if not inline:
            close(PARAGRAPH, PARAGRAPH_SCOPES)
            if tag in CLOSED_BY:
                close(CLOSED_BY[tag], CELL_SCOPES if tag in CELLS else ITEM_SCOPES)
        elif tag == "a" and links:
            close(frozenset(["a"]), SCOPES)
        parent = nodes[stack[-1]]
        by_name, hidden = marked(attributes) if attributes and not parent.unseen and tag not in ("html", "body") else (False, False)
        unseen = parent.unseen or hidden or tag in UNSEEN and not (tag == "header" and parent.inside)
        path = paths.setdefault((parent.path, tag), len(paths) + 1)
        nodes.append(Node(tag, stack[-1], path, unseen, parent.marked or by_name and tag != "main" or tag == "form", parent.inside or tag in MAIN and not by_name))
        if tag in RAW:
            # Nothing but its own end tag ends such an element.
            ends = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            at = ends.start() if ends else len(page)
        if not (attributes.endswith("/") and tag in ("svg", "math")):
            stack.append(len(nodes) - 1)
            links += tag == "a"
    flush()
    return nodes, blocks


def smooth(values: np.ndarray, width: float = 1.0, reach: int = 2) -> np.ndarray:
    """Gaussian mean over neighbours in page order."""
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / width) ** 2)
    held = np.convolve(values, weights, "same") if len(values) > 2 * reach else np.array(
        [sum(weights[j - i + reach] * values[j] for j in range(max(0, i - reach), min(len(values), i + reach + 1))) for i in range(len(values))])
    share = np.array([weights[max(0, reach - i):reach + min(reach + 1, len(values) - i)].sum() for i in range(min(len(values), reach))])
    total = np.full(len(values), weights.sum())
    total[:len(share)] = share
    total[len(total) - len(share):] = np.minimum(total[len(total) - len(share):], share[::-1])
    return held / total


def path_scores(blocks: list[Block], nodes: list[Node], prior: float = 8.0) -> np.ndarray:
    """A score for each block, the mean over its tag path.

    Per path: characters outside links a block, and punctuation a block. Both are smoothed over the blocks in page order, scaled by
    their largest, and fused by their product root; paths inside ``article`` or ``main`` weigh ``prior`` times.
    """
    _, path = np.unique([b.path for b in blocks], return_inverse=True)
    size = np.bincount(path)
    plain = np.array([max(0, len(b.text) - b.linked) for b in blocks], float)
    points = np.array([len(PUNCTUATION.findall(b.text)) for b in blocks], float)
    fused = np.ones(len(blocks))
    for values in (plain, points):
        ratio = smooth((np.bincount(path, values) / size)[path])
        fused *= (ratio + 1e-9) / (ratio.max() + 1e-9)
    fused = np.sqrt(fused) * np.array([prior if nodes[b.node].inside else 1.0 for b in blocks])
    return (np.bincount(path, fused) / size)[path]


def container(nodes: list[Node], blocks: list[Block], chosen: np.ndarray, share: float = 0.8, slack: float = 0.1) -> int:
    """The element that holds the article: the innermost group with at least ``share`` of the chosen blocks' characters.

    From there on outwards: to the ``article`` or else ``main`` around it, and to any group that adds nothing but headings, content
    and at most ``slack`` of the characters in other blocks, as long as that isn't the whole page.
    """
    held, other = np.zeros(len(nodes)), np.zeros(len(nodes))
    for b, yes in zip(blocks, chosen, strict=True):
        held[b.node] += len(b.text) if yes else 0
        other[b.node] += len(b.text) if not yes and nodes[b.node].tag not in HEADINGS else 0
    for k in range(len(nodes) - 1, 0, -1):
        held[nodes[k].parent] += held[k]
        other[nodes[k].parent] += other[k]
    top = int(np.flatnonzero(held >= share * held[0])[-1])
    while nodes[top].tag not in GROUPS:
        top = nodes[top].parent
    up, wanted = top, ("article", "main")
    while up and nodes[up].tag not in wanted and nodes[up].inside:
        up = nodes[up].parent
    if nodes[up].tag in wanted:
        return up
    while (up := nodes[top].parent) > 0 and nodes[up].tag not in ("html", "body") and other[up] - other[top] <= slack * held[up]:
        top = up
    return top


def within(nodes: list[Node], top: int) -> np.ndarray:
    """Whether each element is ``top`` or inside it; parents come before children."""
    inside = np.zeros(len(nodes), bool)
    inside[top] = True
    for k in range(top + 1, len(nodes)):
        inside[k] = inside[nodes[k].parent]
    return inside


def main_text(page: str | None, threshold: float = 0.5) -> str:
    """The page's article: its blocks in page order, one line each; empty if there is none.

    Parts that HTML or their class, id or role names as something else than the article are left out; if nothing stays, classes, ids and
    roles are not looked at. Paths whose score is at least ``threshold`` standard deviations (of the blocks' scores; at most the largest) are content.
    Of the element that holds the content (see ``container``) every block is kept, short ones and headings too, but for
    lists of mere links; if that is the whole page, its groups without any content are left out.
    """
    if not page:
        return ""
    nodes, found = parsed(page)
    blocks = [b for b in found if not nodes[b.node].marked] or found
    if not blocks:
        return ""
    scores = path_scores(blocks, nodes)
    chosen = scores >= min(threshold * float(scores.std()), float(scores.max()))
    top = container(nodes, blocks, chosen)
    whole = nodes[top].tag in WHOLE
    kept = within(nodes, 0 if whole else top)
    if whole:
        full = np.zeros(len(nodes), bool)
        full[[b.node for b, yes in zip(blocks, chosen, strict=True) if yes]] = True
        for k in range(len(nodes) - 1, 0, -1):
            full[nodes[k].parent] |= full[k]
        for k in range(1, len(nodes)):
            parent = nodes[k].parent
            kept[k] = kept[parent] and (full[k] or nodes[k].tag not in GROUPS)
    lines = []
    for b in blocks:
        menu = b.linked >= 0.8 * len(b.text) and nodes[b.node].tag not in HEADINGS and not PUNCTUATION.match(b.text[-1])
        if kept[b.node] and not menu:
            lines.append(b.text)
    return "\n".join(lines)


def extracted(pages: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page: ``main_text`` of its whole ``html``.

    Null and empty pages, and pages without an article, give an empty text. Repeated rows and null ids are rows of their own;
    other columns are ignored; an empty table gives an empty one. Rows stay where they are: no shuffle.
    """
    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p, threshold) for p in batch], dtype=object)

    rows = small_batches(pages).select("page_id", "url", text_of(F.col("html")).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
