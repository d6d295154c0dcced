"""Main text of web pages by tree scoring.

Paragraphs give points for length and commas to their ancestors, halved at every level and discounted
by link density; the best container is kept, together with siblings that score well or read like
prose.  Names of elements (class, id, role) never decide alone: words of page furniture weigh down the
points of what they name, and a named part is left out only if, so weighed, it is light beside the rest
of the article.  A container that holds the page's prose is therefore kept whatever it is called.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from segrank.llm.common import arrow_rows, require

#: Elements of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head script style noscript template title iframe object embed svg math canvas nav header footer aside button select textarea input menu dialog xmp noembed noframes audio video map".split())
INLINE = frozenset("a b big code em font i nobr s small strike strong tt u span sub sup".split())
#: A start tag of the key closes an open element of the value, up to the nearest element of the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in class, id and role. READERS name what readers write, often longer than the article; STRONG ones weigh less; WEAK ones least, and not at all beside a word of GOOD.
READERS = frozenset("comment comments disqus replies respond".split())
STRONG = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors cookie cookies consent gdpr sidebar breadcrumb breadcrumbs navigation nav navbar menu masthead newsletter popup modal paywall pagination pager widget complementary contentinfo toolbar".split())
WEAK = frozenset("alert banner byline footer header login meta notice promo promotion related recommended reply search share sharing signup skip social subscribe subscription tags".split())
GOOD = frozenset("article body content entry main post story text".split())
#: Names that begin like this say what a page has, not what an element is.
MODIFIERS = ("has-", "with-", "no-", "is-", "without-", "hide-", "show-")
#: What a named element's points are worth, and the share of the rest's points that keeps it in the article.
READERS_FACTOR, STRONG_FACTOR, WEAK_FACTOR, KEPT_SHARE = 0.003, 0.03, 0.25, 0.5
#: A container is left for a higher one that holds so many times its points.
CLIMB = 1.5

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORD = re.compile(r"[a-z0-9]+")
RAW_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}
PAGE = frozenset(("#", "html", "body"))
PARAGRAPH = frozenset("p pre td blockquote li dd dt h1 h2 h3 h4 h5 h6".split())


class Node:
    """An element. ``weight``: the product of the factors of it and its ancestors; ``mass``: weighed points inside; ``score``: the same, halved by level."""

    __slots__ = ("tag", "parent", "items", "skip", "named", "weight", "own", "links", "mass", "score")

    def __init__(self, tag: str, parent: Node | None, factor: float = 1.0):
        self.tag, self.parent, self.items = tag, parent, []
        self.skip, self.named = factor == 0, factor < 1
        self.weight = factor * (parent.weight if parent is not None else 1.0)
        self.own = self.links = 0
        self.mass = self.score = 0.0


def factor_of(tag: str, attributes: str) -> float:
    """0 for what can't be of the article by its kind or hiding, less than 1 for names of page furniture and for forms, else 1."""
    if tag in DROPPED:
        return 0.0
    factor = STRONG_FACTOR if tag == "form" else 1.0
    if not attributes or tag in PAGE:
        return factor
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return 0.0
        if name == "style":
            if "display:none" in value.replace(" ", ""):
                return 0.0
            continue
        words = {w for part in value.split() if not part.startswith(MODIFIERS) for w in WORD.findall(part)}
        if words & READERS:
            factor = min(factor, READERS_FACTOR)
        elif words & STRONG:
            factor = min(factor, STRONG_FACTOR)
        elif words & WEAK and not words & GOOD:
            factor = min(factor, WEAK_FACTOR)
    return factor


def parse(page: str) -> list[Node]:
    """The elements, parents first, the root in front; end tags that are missing, crossed or too many are borne. Never recursive."""
    root = at = Node("#", None)
    nodes = [root]
    pos, end, quotes = 0, len(page), True
    while pos < end:
        lt = page.find("<", pos)
        if lt < 0:
            at.items.append(page[pos:])
            break
        if lt > pos:
            at.items.append(page[pos:lt])
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            pos = end if stop < 0 else stop + 3
            continue
        mark = page[lt + 1 : lt + 2]
        if mark in ("!", "?"):
            stop = page.find(">", lt)
            pos = end if stop < 0 else stop + 1
            continue
        if not (mark.isascii() and mark.isalpha() or mark == "/" and page[lt + 2 : lt + 3].isalpha()):
            at.items.append("<")
            pos = lt + 1
            continue
        m = TAG.match(page, lt) if quotes else None
        if m:
            closing, tag, attributes, pos = m[1], m[2].lower(), m[3], m.end()
        else:  # an unclosed quote or tag: up to the next >
            stop = page.find(">", lt)
            if stop < 0:
                break
            quotes = False
            parts = page[lt + 1 : stop].strip("/").split(None, 1) or [""]
            closing, tag, attributes, pos = page[lt + 1 : lt + 2] == "/" and "/", parts[0].lower(), "".join(parts[1:]), stop + 1
        if closing:
            n, inline = at, tag in INLINE
            while n.parent is not None and n.tag != tag and not (inline and n.tag in BLOCK):
                n = n.parent
            if n.tag == tag and n.parent is not None:
                at = n.parent
            continue
        if tag in BLOCK:
            n = at
            while n.parent is not None and n.tag != "p" and (n.tag in INLINE or n.tag not in BLOCK):
                n = n.parent
            if n.tag == "p":
                at = n.parent
        if tag in CLOSES:
            shut, within = CLOSES[tag]
            n, last = at, None
            while n.parent is not None and n.tag not in within:
                if n.tag in shut:
                    last = n
                n = n.parent
            if last is not None:
                at = last.parent
        elif tag == "body":
            n = at
            while n.parent is not None and n.tag != "head":
                n = n.parent
            if n.tag == "head":
                at = n.parent
        node = Node(tag, at, factor_of(tag, attributes))
        at.items.append(node)
        nodes.append(node)
        if tag in RAW:
            stop = RAW_END[tag].search(page, pos)
            pos = stop.end() if stop else end
        elif tag not in VOID and not attributes.endswith("/"):
            at = node
    return nodes


def blocks(top: Node, left_out: Callable[[Node], bool] = lambda n: False) -> Iterator[tuple[Node, str, int]]:
    """The texts of ``top`` in page order, as (nearest block, text, characters in links), without elements of factor 0 and those to be left out."""
    text: list[str] = []
    links, box = 0, top
    stack: list = [(top, 0, False)]
    while stack:
        node, i, linked = stack.pop()
        block = node.tag in BLOCK or node is top
        if i == 0 and block:
            if text:
                yield box, "".join(text), links
                text, links = [], 0
            box = node
        while i < len(node.items):
            item = node.items[i]
            i += 1
            if isinstance(item, str):
                piece = entities.unescape(item) if "&" in item else item
                text.append(piece)
                if linked:
                    links += len(piece.strip())
            elif item.tag == "br":
                text.append("\n")
            elif not item.skip and not left_out(item):
                stack.append((node, i, linked))
                stack.append((item, 0, linked or item.tag == "a"))
                break
        else:
            if block:
                if text:
                    yield box, "".join(text), links
                    text, links = [], 0
                box = node.parent
                while box is not None and box.parent is not None and box.tag not in BLOCK and box is not top:
                    box = box.parent
    if text:
        yield box or top, "".join(text), links


def points_of(text: str, links: int) -> float:
    """One for a block, one for each comma, up to three for length; less the share of its characters in links."""
    commas = text.count(",") + text.count("、") + text.count("，")
    return (1 + commas + min(len(text) / 100, 3)) * max(0.0, 1 - links / len(text))


def value(n: Node) -> float:
    return n.score * (1.5 if n.tag in ("article", "main") else 1.0) * (1 - n.links / max(1, n.own))


def score(nodes: list[Node]) -> None:
    """Points of all blocks go to their containers, and from there up, children before parents."""
    for box, text, links in blocks(nodes[0]):
        if text := " ".join(text.split()):
            points = points_of(text, links) * box.weight
            box.own, box.links, box.mass = box.own + len(text), box.links + links, box.mass + points
            (box.parent if box.tag in PARAGRAPH and box.parent is not None else box).score += points
    for n in reversed(nodes):
        if (p := n.parent) is not None and not n.skip:
            p.own, p.links, p.mass, p.score = p.own + n.own, p.links + n.links, p.mass + n.mass, p.score + n.score / 2


def containers(nodes: list[Node]) -> list[Node]:
    """The best container and its good siblings, in page order."""
    best = max(nodes, key=value)
    if value(best) <= 0:
        return []
    n, article = best, None
    while n is not None:  # the outermost <article> around it, else <main>
        if n.tag == "article" or n.tag == "main" and (article is None or article.tag == "main"):
            article = n
        n = n.parent
    if article is not None:
        return [article]
    n = best.parent
    while n is not None and n.tag not in PAGE:
        if n.mass >= CLIMB * best.mass and 2 * n.links < n.own:
            best = n
        n = n.parent
    if best.parent is None or best.tag in PAGE:
        return [best]
    least = max(3.0, 0.2 * value(best))
    good = lambda n: (n.mass >= KEPT_SHARE * best.mass or not n.named) and (value(n) >= least or n.tag == "p" and n.mass >= 1.5 or n.tag in ("h1", "h2"))
    return [n for n in best.parent.items if n is best or isinstance(n, Node) and not n.skip and good(n)]


def main_text(page: str | None) -> str:
    """The article of a page: the blocks of the best container and its good siblings, joined by spaces; empty if there is none."""
    if not page:
        return ""
    nodes = parse(page)
    score(nodes)
    tops = containers(nodes)
    whole = sum(n.mass for n in tops)
    light = lambda n: n.named and n.mass < KEPT_SHARE * (whole - n.mass)
    texts = (" ".join(text.split()) for top in tops for _, text, _ in blocks(top, light))
    return " ".join(filter(None, texts))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, url, text, n_chars: the main text of every page, page by page without a shuffle.

    Null and empty pages, and pages of nothing but links and what is outside an article, give empty text; an empty
    table gives no rows; repeated rows are extracted each; of equally good containers the first counts; extra columns
    are not read, whatever their names. Very long pages are read whole, in memory that grows with the page; nesting of
    any depth needs no recursion.
    """
    require(pages, id_col, url_col, html_col)
    from pyspark.sql.pandas.types import to_arrow_type

    kind = pages.schema[id_col].dataType

    def work(rows):
        for key, url, page in rows:
            text = main_text(page)
            yield key, url, text, len(text)

    return arrow_rows(pages, [id_col, url_col, html_col], f"{id_col} {kind.simpleString()}, url string, text string, n_chars long", work, [id_col, "url", "text", "n_chars"], [to_arrow_type(kind), pa.string(), pa.string(), pa.int64()], 256)
