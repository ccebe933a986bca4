"""Main text of web pages by scoring a tree of their elements."""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>""", re.S)
_ATTR = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

RAW = frozenset("script style title textarea noscript template iframe xmp noframes svg math object select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose start ends an open paragraph.
_BREAKS_P = frozenset("address article aside blockquote body center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that end an open one of the given names, up to the element that holds them.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
         "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
#: Elements that never hold the article, and what the class, id or role of such elements says.
ASIDE = frozenset("head nav footer aside form menu dialog button input fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "sidebar side aside rail widget footer foot masthead topbar breadcrumb breadcrumbs cookie cookies consent gdpr notice "
    "alert popup modal overlay newsletter subscribe signup comment comments commentlist disqus discussion reply replies respond "
    "share sharing social related recommended recommendations pagination pager toolbar search login skip legal copyright".split())
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
#: Words that make what follows in a class name a remark on the page's layout, as in no-sidebar.
LAYOUT = frozenset("has with without no".split())
#: Words of elements that are no article while there is any other text of an article.
STRICT = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr "
    "comment comments commentlist disqus discussion reply replies respond".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd section div article main body".split())
HOLDERS = ("article", "main")
#: A paragraph scores one point, one a comma, and one per 100 characters up to three.
SHORTEST, PER_POINT, MOST_POINTS = 25, 100, 3
#: Share of the best score from which a sibling is kept, and the least score for it.
SIBLING_SHARE, SIBLING_LEAST = 0.2, 10
#: How often an element with a word of ASIDE_WORDS must hold the points of the rest of the page to be
#: kept: usually, with the page's headline inside, and with a headline or article elsewhere; and the
#: least points that an article elsewhere counts as.
BULK, HEADLINE, ELSEWHERE, LEAST_PAGE = 2, 0.5, 4, 3


class Node:
    __slots__ = ("name", "parent", "parts", "aside", "words", "score", "chars", "linked", "own", "commas")

    def __init__(self, name: str, parent: Node | None, aside: bool, words: frozenset[str] = frozenset()):
        # words: those of ASIDE_WORDS in its class and id, for which alone it is aside
        self.name, self.parent, self.aside, self.words = name, parent, aside or bool(words), words
        self.parts: list[str | Node] = []
        self.score = 0.0
        self.chars = self.linked = self.own = self.commas = 0


def _is_aside(name: str, attrs: str, parent: Node) -> bool:
    if name in ASIDE:
        return True
    if name == "header":  # a page's header; an article's own holds its title
        return not _inside(parent, HOLDERS)
    if not attrs or name in ("html", "body", "article", "main"):
        return False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key == "role" and value.lower() in ROLES:
            return True
    return False


def _aside_words(name: str, attrs: str) -> frozenset[str]:
    """Those of ASIDE_WORDS in class and id, but for what follows a word of LAYOUT in a name."""
    found: set[str] = set()
    if not attrs or name in ("html", "body", "article", "main"):
        return frozenset()
    for key, value in _ATTR.findall(attrs):
        if key.lower() in ("class", "id"):
            for each in value.strip("\"'").split():
                for word in _SPLIT.split(each):
                    word = word.lower()
                    if word in LAYOUT:
                        break
                    if word in ASIDE_WORDS:
                        found.add(word)
    return frozenset(found)


def _inside(node: Node | None, names: tuple[str, ...]) -> bool:
    while node is not None:
        if node.name in names:
            return True
        node = node.parent
    return False


def parse(html: str) -> Node:
    """A tree of elements and texts. Elements left open end where HTML says they do."""
    root = Node("html", None, False)
    at, here = 0, root
    while True:
        found = _TAG.search(html, at)
        text = html[at:found.start()] if found else html[at:]
        if text:
            here.parts.append(unescape(text))
        if not found:
            return root
        at = found.end()
        if found["cdata"]:
            here.parts.append(found["cdata"])
        name = (found["name"] or found["name2"] or "").lower()
        if not name:
            continue
        if found["end"] or found["end2"]:
            node = here
            while node is not None and node.name != name:
                node = node.parent
            if node is not None and node.parent is not None:
                here = node.parent
            continue
        attrs = found["attrs"] or found["attrs2"] or ""
        if name == "html":
            continue
        if name in RAW:
            if not attrs.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = close.end() if close else len(html)
            if name not in INLINE:
                here.parts.append(Node("br", here, False))
            continue
        if name in _BREAKS_P:
            here = _closed(here, {"p"}, {"td", "th", "li", "button", "article", "section", "div", "blockquote", "body"})
        if name in _ENDS:
            here = _closed(here, *_ENDS[name])
        aside = _is_aside(name, attrs, here)
        node = Node(name, here, aside, frozenset() if aside else _aside_words(name, attrs))
        here.parts.append(node)
        if name not in VOID and not (attrs.endswith("/") and name in INLINE):
            here = node


def _closed(here: Node, names: set[str], stop: set[str]) -> Node:
    node: Node | None = here
    while node is not None and node.name not in stop:
        if node.name in names:
            return node.parent or here
        node = node.parent
    return here


def _measure(root: Node) -> list[Node]:
    """Fill in characters, commas and linked characters of every kept element, children first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        node.chars = node.linked = node.own = node.commas = 0
        todo += [x for x in node.parts if isinstance(x, Node) and not x.aside]
    for node in reversed(order):
        for part in node.parts:
            if isinstance(part, str):
                n = len(part.strip())
                node.chars += n
                node.own += n
                node.commas += part.count(",")
            elif not part.aside:
                node.chars += part.chars
                node.linked += part.linked
                if part.name in INLINE:
                    node.own += part.own
                    node.commas += part.commas
        if node.name == "a":
            node.linked = node.chars
    return order


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _points(node: Node) -> float:
    """Points of a measured element as a paragraph; 0 if it is none."""
    if node.name not in PARAGRAPHS or node.own < SHORTEST or _density(node) > 0.5:
        return 0.0
    return 1 + node.commas + min(node.own / PER_POINT, MOST_POINTS)


def _named(root: Node) -> list[Node]:
    """The elements that are aside by their class words alone, but for those in others cut for good."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.words:
            found.append(node)
        todo += [x for x in node.parts if isinstance(x, Node) and (x.words or not x.aside)]
    return found


def _keep_bulk(root: Node) -> None:
    """Take back the cut of elements that are aside by their class words alone but are the bulk of the page.

    The paragraph points in such an element are weighed against the points of the page outside of
    all of them. One that outweighs the page clearly is kept, the heaviest first, and its page then
    counts; its siblings of the same words are kept with it, and what is inside of it is weighed in turn.
    It has to outweigh more where the page has a headline or article elsewhere, less where it holds
    them. Adverts and reader comments are kept only if the page has nothing else.
    """
    named = _named(root)
    if not named:
        return
    for node in named:
        node.aside = False
    order = _measure(root)
    worth = {id(x): _points(x) for x in order}
    # of what is not in a named element further down: points, headlines, article parts; any text
    page = {id(x): [worth[id(x)], 0, 0] for x in order}
    plain = {id(x): any(isinstance(p, str) and p.strip() for p in x.parts) for x in order}
    marks = {id(x): [0, 0] for x in order}
    for node in reversed(order):  # children first
        for i, is_mark in enumerate((node.name == "h1", node.name in HOLDERS)):
            marks[id(node)][i] += is_mark and node.chars > 0
            page[id(node)][i + 1] += is_mark and plain[id(node)]
        up = id(node.parent)
        if node is root:
            continue
        worth[up] += worth[id(node)]
        marks[up] = [x + y for x, y in zip(marks[up], marks[id(node)])]
        if not node.words:
            plain[up] |= plain[id(node)]
            page[up] = [x + y for x, y in zip(page[up], page[id(node)])]
    below: dict[int, list[tuple[float, int, Node]]] = {}
    above, around = {id(root): id(root)}, {id(root): 0}
    for k, node in enumerate(order):  # parents first
        if node is not root:
            up = node.parent
            above[id(node)] = id(up) if up.words else above[id(up)]
            around[id(node)] = around[id(up)] + (up.name in HOLDERS and plain[id(up)])
            if node.words:
                below.setdefault(above[id(node)], []).append((-worth[id(node)] * (1 - _density(node)), k, node))
    for node in named:
        node.aside = True
    points, headlines, holders = page[id(root)]
    heap, least = below.get(id(root), []), {}
    heapify(heap)
    while heap and heap[0][0] < 0:
        value, _, node = heappop(heap)
        value, elsewhere, alike = -value, holders - around[id(node)], (id(node.parent), node.words)
        if node.words & STRICT:
            keep = not points and not holders
        elif elsewhere:
            keep = not headlines and value > ELSEWHERE * max(points, LEAST_PAGE)
        elif headlines:
            keep = value > ELSEWHERE * points
        else:
            keep = value > points * (HEADLINE if marks[id(node)][0] else 1 if marks[id(node)][1] else BULK)
        if keep:
            least.setdefault(alike, SIBLING_SHARE * value)
        elif value < least.get(alike, value + 1):
            continue
        node.aside = False
        points, headlines, holders = (x + y for x, y in zip((points, headlines, holders), page[id(node)]))
        for x in below.get(id(node), []):
            heappush(heap, x)


def _best(root: Node) -> list[Node]:
    """The elements whose text is the article, in page order."""
    order = _measure(root)
    scored: set[Node] = set()
    for node in order:
        points = _points(node)
        if not points:
            continue
        up, share = (node.parent if node.name not in ("div", "section", "article", "main", "body") else node), 1.0
        level = 0
        while up is not None and level < 5:
            up.score += points * share
            scored.add(up)
            level += 1
            share = 0.5 if level == 1 else 1 / (level * 3)
            up = up.parent
    ranked = [(x.score * (1 - _density(x)), x) for x in scored]
    holders = [x for x in order if x.name in HOLDERS and x.chars]
    if not ranked:
        if holders:
            return [max(holders, key=lambda x: x.chars * (1 - _density(x)))]
        return [next((x for x in order if x.name == "body"), root)]
    value, best = max(ranked, key=lambda x: x[0])
    node: Node | None = best
    while node is not None:  # the whole article or main part around it
        if node.name in HOLDERS:
            return [node]
        node = node.parent
    inner = [x for x in holders if _within(x, best) and x.chars * 2 > best.chars]
    if inner:
        return [max(inner, key=lambda x: x.chars)]
    if best.parent is None:
        return [best]
    final, least = {id(x): v for v, x in ranked}, max(SIBLING_LEAST, SIBLING_SHARE * value)
    kept = []
    for part in best.parent.parts:
        if not isinstance(part, Node) or part.aside:
            continue
        near = part.name in ("p", "h1", "h2", "h3", "pre", "blockquote") and part.chars and _density(part) < 0.25
        if part is best or final.get(id(part), 0) >= least or near:
            kept.append(part)
    return kept


def _within(node: Node | None, other: Node) -> bool:
    while node is not None:
        if node is other:
            return True
        node = node.parent
    return False


def _text(nodes: list[Node]) -> str:
    """Texts in page order, a space where a block begins or ends, white space as one space."""
    out: list[str] = []
    todo: list[Node | str] = list(reversed(nodes))
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
        elif not part.aside:
            gap = [] if part.name in INLINE else [" "]
            todo += gap + part.parts[::-1] + gap
        elif part.name not in INLINE:
            out.append(" ")
    return " ".join("".join(out).split())


def main_text(html: str | None) -> str:
    """The article of a page; empty for a null or empty page or one without any text."""
    if not html:
        return ""
    root = parse(html)
    _keep_bulk(root)
    return _text(_best(root))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Paragraphs give points for length and commas to the elements around them, less the further
    away, discounted by the share of linked text; the best element and its worthy siblings are
    kept whole, without menus, headers, footers, sidebars, notices, adverts, forms and reader
    comments. A class or id that names one of these does not cut what is the bulk of the page. Every row is worked on by itself, so repeated rows give repeated results.
    """
    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [main_text(x) for x in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": found,
                                "n_chars": [len(x) for x in found]})

    kind = pages.schema["page_id"].dataType.simpleString()
    plain = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", F.col("html").cast("string").alias("html"))
    out = plain.mapInPandas(texts, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast(kind))
