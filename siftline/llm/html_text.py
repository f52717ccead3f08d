"""Main text of web pages by composite text density.

The page becomes a tree of its block elements (inline tags count as tags of
the block they stand in). A node's density is its characters per tag, adjusted
for links as by Sun, Song and Liao (2011); its density sum is the sum over its
children. The node with the greatest sum is the core. The least density on the
path from the core up to the body is the threshold: on that path, side branches
that reach it belong to the text as well. Elements that by name, role or class
are no article text (menus, adverts, forms, comments and so on) are left out
before. Where the page marks an article (else a main element) that holds at least
as many characters as the core has outside it, the body of the path is that
element and the core is searched in it. Other such elements of the threshold's
density belong to the text as well.
"""

from __future__ import annotations

import math
import re
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, read_table

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "select", "canvas", "audio", "video"}
DROPPED = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "head", "fieldset", "search"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar", "tablist", "note"}
WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion promoted banner banners "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager header masthead topbar footer bottombar sidebar sidebars aside rail widget widgets "
    "notice notices notification notifications alert cookie cookies consent gdpr popup modal overlay disclaimer paywall "
    "comment comments commentlist disqus reply replies respond discussion "
    "share sharing social follow newsletter subscribe subscription signup login related recommended recommendations teaser teasers "
    "form search searchbox searchform toolbar skip".split()
)
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
BLOCKS = set("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary center hgroup".split()) | DROPPED
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
STOPS = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "html", "main", "blockquote"}


def _noise(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    if tag in ("body", "html", "main", "article") and "comment" not in attributes:
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and not WORDS.isdisjoint(re.split(r"[\s_-]+", value)):
            return True
    return False


class Node:
    __slots__ = ("tag", "parent", "children", "texts", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children, self.texts = tag, parent, [], []
        self.chars = self.link_chars = self.link_tags = 0
        self.tags, self.density, self.sum = 1, 0.0, 0.0


class Open:
    """The open tags, with the places of each name among them, so that closing one never searches the others."""

    def __init__(self):
        self.tags: list[tuple[str, Node | None, int]] = []  # tag, the node before it if it is a block, noise depth before it
        self.places: dict[str, list[int]] = {}

    def add(self, tag: str, before: Node | None, noise: int) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        self.tags.append((tag, before, noise))

    def last(self, names) -> int:
        """Place of the last open tag among ``names``; -1 if there is none."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=-1)

    def close(self, place: int):
        """Takes off the tags from the last one down to ``place``."""
        while len(self.tags) > place:
            tag, before, noise = self.tags.pop()
            self.places[tag].pop()
            yield tag, before, noise


def parse(html: str) -> tuple[Node, list[tuple[Node, int, str]]]:
    """The tree of blocks without noise, and its texts in page order, each with its block's number. A line break is white space.

    Every step takes the text on or takes an open tag off, so the time follows the length of the page.
    """
    root = Node("html", None)
    node, texts, block = root, [], 0
    opened, unclosed = Open(), set()
    noise = links = 0
    at, size = 0, len(html)
    last = html.rfind(">") + 1  # no tag ends after this
    while at < size:
        found = TOKEN.search(html, at, last) if at < last else None
        end = found.start() if found else size
        if end > at and not noise:
            texts.append((node, block, html[at:end]))
            n = len(html[at:end].strip())
            node.chars += n
            node.link_chars += n * bool(links)
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            if found[0].startswith("<!--") and not found[0].endswith("-->"):
                break
            continue
        if found[1]:
            place = opened.last((tag,))
            if place >= 0:
                for name, before, depth in opened.close(place):
                    links -= name == "a" and links > 0
                    noise = depth
                    if before is not None:
                        node = before
                        block += 1
            continue
        if tag in RAW:
            close = None if tag in unclosed else re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at, last)
            if close is None:
                unclosed.add(tag)
            at = close.end() if close else size if tag not in ("svg", "object") else at
            continue
        if tag == "br" and not noise:
            texts.append((node, block, " "))
        if tag in VOID or found[3].endswith("/") and tag not in BLOCKS and tag != "a":
            if not noise:
                node.tags += 1
            continue
        shut = {"p"} if tag in BLOCKS else set()
        shut |= CLOSES.get(tag, set())
        place = opened.last(shut)
        if place > opened.last(STOPS):
            for name, before, depth in opened.close(place):
                links -= name == "a" and links > 0
                noise = depth
                if before is not None:
                    node = before
        bad = noise or _noise(tag, found[3])
        if tag in BLOCKS:
            block += 1
            opened.add(tag, node, noise)
            if not bad:
                child = Node(tag, node)
                node.children.append(child)
                node = child
        else:
            opened.add(tag, None, noise)
            if not bad:
                node.tags += 1
                node.link_tags += tag == "a"
        links += tag == "a"
        noise = int(bool(bad))
    return root, texts


def _walk(root: Node) -> list[Node]:
    out, left = [], [root]
    while left:
        node = left.pop()
        out.append(node)
        left.extend(node.children)
    return out


def weigh(root: Node) -> None:
    """Sums counts up the tree, then gives each node its composite text density and density sum."""
    nodes = _walk(root)
    for n in reversed(nodes):
        if n.parent is not None:
            for k in ("chars", "tags", "link_chars", "link_tags"):
                setattr(n.parent, k, getattr(n.parent, k) + getattr(n, k))
    share = root.link_chars / root.chars if root.chars else 0.0
    for n in reversed(nodes):
        if n.chars:
            plain = max(n.chars - n.link_chars, 1)
            base = math.log(n.chars / plain * n.link_chars + share * n.chars + math.e)
            n.density = n.chars / n.tags * math.log(max(n.chars / max(n.link_chars, 1) * n.tags / max(n.link_tags, 1), 1.0) + 1e-9) / math.log(max(base, 1.0) + 1.0)
            n.density = max(n.density, 0.0)
        n.sum = sum(c.density for c in n.children)


def _above(node: Node, top: Node) -> list[Node]:
    """The path from a node up to ``top``, both included."""
    path = [node]
    while path[-1] is not top and path[-1].parent is not None:
        path.append(path[-1].parent)
    return path


def main_text(html: bytes | None) -> str:
    """The text of a page's article: blocks in page order, joined by line feeds; empty if there is none."""
    root, texts = parse((html or b"").decode("utf-8", "replace"))
    weigh(root)
    nodes = _walk(root)
    marked = [n for n in nodes if n.tag == "article" and n.chars] or [n for n in nodes if n.tag == "main" and n.chars]
    core, top = max(nodes, key=lambda n: n.sum), root
    if marked:
        best = max(marked, key=lambda n: (n.chars, n.sum))
        within, around = best in _above(core, root), core in _above(best, root)
        outside = 0 if within else core.chars - best.chars if around else core.chars
        if best.chars >= outside:
            core, top = max(_walk(best), key=lambda n: n.sum), best
    path = _above(core, top)
    least = min((n.density for n in path if n.tag != "html" or n is core), default=0.0)
    taken = set(map(id, _walk(core)))
    on_path = set(map(id, path))
    for n in path[1:]:
        taken.add(id(n))
        for c in n.children:
            if id(c) not in on_path and c.density >= least:
                taken.update(map(id, _walk(c)))
    for n in marked:
        if id(n) not in on_path and id(n) not in taken and n.density >= least:
            taken.update(map(id, _walk(n)))
    blocks: dict[int, list[str]] = {}
    for node, block, text in texts:
        if id(node) in taken:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join(unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    A null, empty or textless page has the empty text. Rows with null or
    repeated ids are kept. No rows give no rows. Pages of any length are read
    whole, in time in proportion to it. Of nodes with equal density sums the first
    in the walk is the core. Columns other than page_id, url and html are ignored.
    """

    def rows(source):
        for r in source:
            text = main_text(r["html"])
            yield r["page_id"], r["url"].decode() if r["url"] is not None else None, text, len(text)

    return map_rows(pages.select(F.col("page_id").cast("long"), "url", "html"), rows, "page_id long, url string, text string, n_chars long")


def op4_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
