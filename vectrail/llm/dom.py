"""HTML as a tree of blocks: a lenient parser, and features of its nodes.

Start and end tags are read as browsers do in the common cases: void elements, implied ends of
head, p, li, dt, dd, options and table parts, unmatched ends ignored, raw text in scripts and styles,
self-closed tags inside svg and math, which a block element ends. Inline elements make no nodes.
Character references are decoded within a run of text, never across a tag. A node is a block element
or a run of text between block boundaries; nodes are listed in page order, so a parent comes before
its children. Nothing recurses, and time follows the length of the page whatever is left open.

Defined results: an empty page is its root node alone; a ``<`` that begins no finished tag is text;
where a quote is never closed, tags from there on end at the next ``>``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from html import unescape

import numpy as np

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style template noscript svg iframe object canvas audio video head title textarea select".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
#: Elements whose start ends an open p.
ENDS_P = BLOCKS - {"button", "option", "select", "textarea", "body", "html"}
#: Elements that leave a head open.
HEAD = frozenset("html head base link meta title style script noscript template basefont bgsound".split())
FOREIGN = ("svg", "math")
SCOPES = {
    "p": frozenset("button caption html table td th object body".split()),
    "li": frozenset("ol ul menu table body html".split()),
    "dt": frozenset("dl body html".split()),
    "dd": frozenset("dl body html".split()),
    "option": frozenset("select body html".split()),
    "tr": frozenset("table tbody thead tfoot body html".split()),
    "td": frozenset("tr table body html".split()),
    "th": frozenset("tr table body html".split()),
}
ALSO_ENDS = {"dt": ("dd", "dt"), "dd": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}
BEGINS = re.compile(r"</?[a-zA-Z]")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|itemprop|data-[a-z-]{0,40}(?:type|role))\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

GROUPS = (
    "article main section div p h1 heading list item table nav header footer aside form quote figure caption body control term other".split()
)
GROUP = {g: k for k, g in enumerate(GROUPS)} | {
    **{f"h{k}": 6 for k in range(2, 7)}, "ul": 7, "ol": 7, "menu": 7, "dl": 7, "li": 8, "td": 9, "th": 9, "tr": 9, "tbody": 9,
    "thead": 9, "tfoot": 9, "fieldset": 14, "blockquote": 15, "pre": 15, "figcaption": 17, "html": 18, "button": 19, "label": 19,
    "legend": 19, "option": 19, "dt": 20, "dd": 20, "details": 3, "center": 3, "ins": 21, "summary": 21, "address": 21, "dialog": 21,
}
#: Families of words in class, id and role attributes.
FAMILIES = {
    "content": "content article post entry story text main blog hentry prose",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager topnav sitemap toc tabs",
    "header": "header masthead top topbar logo branding site",
    "footer": "footer foot bottom copyright legal colophon imprint",
    "side": "sidebar side aside rail widget widgets secondary complementary",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense adsbygoogle banner dfp",
    "notice": "cookie cookies consent notice notices alert gdpr popup modal overlay newsletter subscribe subscription signup paywall warning announcement disclaimer",
    "comment": "comment comments commentlist reply replies respond disqus discussion feedback reader",
    "form": "form search login contact register",
    "share": "share sharing social follow related recommend recommended recommendations trending popular tags tag also",
    "meta": "meta byline author date credit time",
}
FAMILY = {w: 1 << k for k, words in enumerate(FAMILIES.values()) for w in words.split()}
N_FAMILIES = len(FAMILIES)
AD = FAMILY["ad"]
ANCESTORS = ("nav", "header", "footer", "aside", "form", "article", "main", "list", "table")


def families(attributes: str) -> int:
    found = 0
    for m in ATTRIBUTE.finditer(attributes):
        for word in PART.findall(m[2] or m[3] or m[4] or ""):
            found |= FAMILY.get(word.lower(), 0)
    return found


class Page:
    """Nodes of one page in order: parent, tag group, families, own text and characters in links."""

    def __init__(self, html: str):
        self.parent, self.group, self.family = [-1], [GROUP["body"]], [0]
        self.text: list[str | None] = [None]
        self.linked = [0]
        self._parse(html)

    def _node(self, parent: int, group: int, family: int, text: str | None, linked: int = 0) -> int:
        self.parent.append(parent)
        self.group.append(group)
        self.family.append(family)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1

    def _parse(self, html: str) -> None:
        tags: list[str] = []
        blocks: list[int] = []  # the node of each open element, or -1 for inline ones
        here = [0]
        opened: dict[str, list[int]] = {}  # the places among tags of the open elements of a name
        pieces: list[str] = []
        linked = dropped = links = at = 0
        size, last, quotes = len(html), html.rfind(">"), True

        def flush() -> None:
            nonlocal linked
            if pieces:
                own = " ".join("".join(pieces).split())
                if own:
                    self._node(here[-1], self.group[here[-1]], self.family[here[-1]], own, min(linked, len(own)))
                pieces.clear()
            linked = 0

        def close() -> None:
            nonlocal dropped, links
            tag, node = tags.pop(), blocks.pop()
            opened[tag].pop()
            if tag in DROPPED:
                dropped -= 1
            if tag == "a":
                links -= 1
            if node >= 0:
                flush()
                here.pop()

        def place(names: Iterable[str]) -> int:
            """Of the last open element of these names, or -1."""
            return max((own[-1] for x in names if (own := opened.get(x))), default=-1)

        def close_to(names: Iterable[str], scope: Iterable[str] = ()) -> None:
            k = place(names)
            if k > place(scope):
                while len(tags) > k:
                    close()

        def token(lt: int) -> re.Match | None:
            nonlocal quotes
            if not BEGINS.match(html, lt):
                return MARK.match(html, lt)
            if lt > last:
                return None
            found = TAG.match(html, lt) if quotes else None
            quotes = found is not None
            return found or PLAIN_TAG.match(html, lt)

        while at < size:
            lt = html.find("<", at)
            m = token(lt) if lt >= 0 else None
            while lt >= 0 and m is None:
                lt = html.find("<", lt + 1)
                m = token(lt) if lt >= 0 else None
            end = lt if lt >= 0 else size
            if end > at:
                if dropped and tags[-1] == "head" and not html[at:end].isspace():
                    close()
                if not dropped:
                    pieces.append(unescape(html[at:end]))
                    if links:
                        linked += end - at
            if m is None:
                break
            at = m.end()
            if m.re is MARK:
                continue
            tag, attributes = m[2].lower(), m[3]
            if m[1]:
                if opened.get(tag):
                    close_to((tag,))
                elif tag in BLOCKS:
                    flush()
                continue
            if opened.get("head") and tag not in HEAD and not opened.get("template"):
                close_to(("head",))
            foreign = place(FOREIGN)
            if foreign >= 0 and tag in ENDS_P and foreign > place(("foreignobject", "desc", "title", "annotation-xml", "mtext")):
                close_to(FOREIGN)
                foreign = -1
            if (foreign >= 0 or tag in FOREIGN) and attributes.endswith("/"):
                continue
            if tag == "br":
                pieces.append(" ")
                continue
            if tag in ENDS_P and opened.get("p"):
                close_to(("p",), SCOPES["p"])
            if tag in SCOPES and tag != "p":
                close_to(ALSO_ENDS.get(tag, (tag,)), SCOPES[tag])
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            family = families(attributes) if (tag in BLOCKS or tag == "ins") and attributes.strip() else 0
            node = -1
            # An inserted text is inline, an inserted advert a block.
            if tag in BLOCKS or family & AD:
                flush()
                node = self._node(here[-1], GROUP.get(tag, GROUP["other"]), family, None)
                here.append(node)
            opened.setdefault(tag, []).append(len(tags))
            tags.append(tag)
            blocks.append(node)
            if tag in DROPPED:
                dropped += 1
            if tag == "a":
                links += 1
            if tag in RAW and foreign < 0:
                stop = re.compile(rf"</{tag}\b", re.I).search(html, at)
                at = stop.start() if stop else size
        flush()


SENTENCE = re.compile(r"[.!?…。！？](?:\s|$)")
NAMES = (
    [f"tag:{g}" for g in GROUPS]
    + ["is_text", "depth", "place", "chars", "words", "link_share", "stops", "leaves", "density", "page_share", "siblings", "sibling_place"]
    + ["before", "after", "parent_links", "parent_chars", "parent_leaves", "blocks", "long_share", "mark", "word_size", "parent_share"]
    + [f"own:{f}" for f in FAMILIES]
    + [f"above:{f}" for f in FAMILIES]
    + [f"in:{a}" for a in ANCESTORS]
    + [f"page:{a}" for a in ("article", "main", "content")]
)


def features(page: Page) -> np.ndarray:
    """One row for each node, columns as in NAMES."""
    n = len(page.parent)
    parent = page.parent
    chars, words, linked, stops, leaves, blocks, longs, marks = (np.zeros(n) for _ in range(8))
    depth, above, inside = [0] * n, [0] * n, [0] * n
    kids: list[list[int]] = [[] for _ in range(n)]
    bit = {GROUP[a]: 1 << k for k, a in enumerate(ANCESTORS)}
    for k in range(n):
        p, text = parent[k], page.text[k]
        if p >= 0:
            depth[k] = depth[p] + 1
            above[k] = above[p] | (page.family[p] if text is None else 0)
            inside[k] = inside[p] | bit.get(page.group[p], 0)
            kids[p].append(k)
        if text is None:
            blocks[k] = 1
        else:
            own = text.count(" ") + 1
            chars[k], words[k], linked[k], leaves[k] = len(text), own, page.linked[k], 1
            stops[k] = len(SENTENCE.findall(text)) if own < 200 else text.count(". ") + 1
            longs[k] = len(text) if own >= 12 else 0
            marks[k] = "©" in text or "copyright" in text[:200].lower()
    for k in range(n - 1, 0, -1):
        p = parent[k]
        for a in (chars, words, linked, stops, leaves, blocks, longs, marks):
            a[p] += a[k]
    index, count, before, after = np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n)
    for own in kids:
        for j, k in enumerate(own):
            index[k], count[k] = j, len(own)
            before[k] = chars[own[j - 1]] if j else 0
            after[k] = chars[own[j + 1]] if j + 1 < len(own) else 0
    up = np.maximum(np.array(parent), 0)
    group, family = np.array(page.group), np.array(page.family)
    above_a, inside_a = np.array(above), np.array(inside)
    is_text = np.array([t is not None for t in page.text])
    links = linked / np.maximum(chars, 1)
    out = np.empty((n, len(NAMES)), np.float32)
    g = len(GROUPS)
    out[:, :g] = group[:, None] == np.arange(g)
    columns = (
        is_text, depth, np.arange(n) / n, np.log1p(chars), np.log1p(words), links, stops / np.maximum(words, 1), np.log1p(leaves),
        np.log1p(chars / np.maximum(blocks + leaves, 1)), chars / max(chars[0], 1), np.log1p(count), index / count, np.log1p(before),
        np.log1p(after), links[up], np.log1p(chars[up]), np.log1p(leaves[up]), np.log1p(blocks), longs / np.maximum(chars, 1),
        marks > 0, chars / np.maximum(words, 1), chars / np.maximum(chars[up], 1),
    )
    for j, c in enumerate(columns):
        out[:, g + j] = c
    j = g + len(columns)
    flags = np.arange(N_FAMILIES)
    out[:, j : j + N_FAMILIES] = (family[:, None] >> flags) & 1
    out[:, j + N_FAMILIES : j + 2 * N_FAMILIES] = (above_a[:, None] >> flags) & 1
    j += 2 * N_FAMILIES
    out[:, j : j + len(ANCESTORS)] = (inside_a[:, None] >> np.arange(len(ANCESTORS))) & 1
    j += len(ANCESTORS)
    out[:, j] = (group == GROUP["article"]).any()
    out[:, j + 1] = (group == GROUP["main"]).any()
    out[:, j + 2] = (family & 1).any()
    return out
