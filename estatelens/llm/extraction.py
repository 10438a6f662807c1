"""Main text of web pages by scoring the tree's containers."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import whole_text

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object textarea title select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
PARAGRAPHS = frozenset("p pre blockquote td dd li".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
APART = frozenset("nav header footer aside form button dialog menu figure".split()) - {"figure"}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer sidebar side aside widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "signup login share sharing social related recommended toolbar pagination pager skip form search".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond discussion".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TOP = frozenset("html body #root".split())
BESIDE = frozenset("has no not with without".split())  # a class name says by these what the page has or lacks besides the element
KIND = frozenset("article body content entry main post story text page".split())


def own_names(attrs: dict[str, str]) -> list[list[str]]:
    """The words of each class name and id, up to a word that says what follows is another part."""
    out = []
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        tokens = [t for t in re.split(r"[^a-z0-9]+", name) if t]
        out.append(tokens[:next((i for i, t in enumerate(tokens) if t in BESIDE), len(tokens))])
    return [x for x in out if x]


class Node:
    __slots__ = ("tag", "names", "sure", "attrs", "parent", "children", "score", "length", "links", "prose")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        named = own_names(attrs) if attrs else []
        self.names = frozenset(t for x in named for t in x)
        self.sure = any(NAMES.issuperset(x) for x in named)  # a whole class name says what the element is
        self.children: list[Node | str] = []
        self.score, self.length, self.links, self.prose = 0.0, 0, 0, 0


def parsed(html: str) -> Node:
    """The page as a tree, with the usual closings of unclosed elements; raw elements are left out."""
    root = at = Node("#root", {}, None)
    place, size = 0, len(html)
    low = None
    while place < size:
        m = TOKEN.match(html, place)
        place = m.end()
        tag = m[2]
        if tag is None:
            s = m[0]
            if s[0] != "<" or s == "<":
                at.children.append(s)
            continue
        tag = tag.lower()
        if m[1]:
            node = at
            while node.parent is not None and node.tag != tag:
                node = node.parent
            if node.parent is not None:
                at = node.parent
            continue
        if tag in RAW:
            low = low if low is not None else html.lower()
            end = low.find(f"</{tag}", place)
            close = html.find(">", end) if end >= 0 else -1
            place = close + 1 if close >= 0 else size if end >= 0 or tag in ("script", "style") else place
            at.children.append(" ")
            continue
        if tag in CLOSES_P:
            node = at
            while node.parent is not None and node.tag in INLINE:
                node = node.parent
            if node.tag == "p":
                at = node.parent
        if tag in SAME:
            node = at
            while node.parent is not None and node.tag != tag and node.tag not in SAME[tag]:
                node = node.parent
            if node.tag == tag:
                at = node.parent
        attrs = {k.lower(): unescape((v or "").strip("\"'")) for k, v in ATTRIBUTE.findall(m[3])} if m[3].strip(" /\t\n") else {}
        node = Node(tag, attrs, at)
        at.children.append(node)
        if tag not in VOID and not m[3].endswith("/"):
            at = node
    return root


def below(node: Node):
    """The nodes below, parents first, without recursion."""
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(c for c in reversed(x.children) if not isinstance(c, str))


def is_gone(node: Node) -> bool:
    """Comments and hidden parts."""
    attrs = node.attrs
    return bool(node.names & COMMENTS or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower())


def has_part_kind(node: Node) -> bool:
    return node.tag in APART or node.attrs.get("role", "").lower() in ROLES


def is_apart(node: Node, prose: int) -> bool:
    """Menus, headers, footers, side bars, notices, adverts, forms, comments and hidden parts.

    A part that only its class or id sets apart stays if it holds most of the page's prose:
    half of it, or three quarters if a whole class name says that it is such a part.
    """
    if node.tag in ("html", "body", "#root", "main"):
        return False
    if is_gone(node):
        return True
    named = has_part_kind(node)
    if not named and node.names & NAMES and node.tag != "article":
        named = not node.prose or node.prose < (0.75 if node.sure else 0.5) * prose
    # a wrapper that is only named after one of its parts holds the article too
    return bool(named) and not any(x.tag in ("article", "main") and not x.names & COMMENTS for x in below(node) if x is not node)


def pruned(root: Node) -> None:
    for x in reversed(list(below(root))):
        apart = x.tag == "a" or x.tag not in ("html", "body", "#root", "main") and (is_gone(x) or has_part_kind(x))
        x.prose = 0 if apart else sum(len(c.strip()) if isinstance(c, str) else c.prose for c in x.children)
    todo = [root]
    while todo:
        x = todo.pop()
        x.children = [c if isinstance(c, str) or not is_apart(c, root.prose) else " " for c in x.children]
        todo.extend(c for c in x.children if not isinstance(c, str))


def measured(root: Node) -> None:
    """Length of the text below each node, and of the part inside links."""
    for x in reversed(list(below(root))):
        own = sum(len(c.strip()) for c in x.children if isinstance(c, str))
        x.length = own + sum(c.length for c in x.children if not isinstance(c, str))
        x.links = x.length if x.tag == "a" else sum(c.links for c in x.children if not isinstance(c, str))


def link_density(node: Node) -> float:
    return node.links / node.length if node.length else 0.0


def text_of(node: Node) -> str:
    """The blocks of a subtree in page order, joined by one space."""
    out: list[str] = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        inline = x.tag in INLINE
        if not inline:
            out.append(" ")
            todo.append(" ")
        todo.extend(reversed(x.children))
    return " ".join(unescape("".join(out)).split())


def main_nodes(root: Node) -> list[Node]:
    """The best container and what goes with it beside it and beside its parents, in page order.

    A paragraph has one point, one for each comma and up to three for its length. Its parent
    gets the points, the parent's parent half of them, and so on up; a container's sum is
    discounted by its link density. Headings, lists, paragraphs and sections beside the best
    container belong to the article if they are not mostly links, whatever their length;
    beside an <article> or <main> only what scores well or is long does.
    """
    containers: dict[int, Node] = {}
    for x in below(root):
        own = x.tag in PARAGRAPHS or (x.tag not in INLINE and x.tag not in PARAGRAPHS and any(isinstance(c, str) and c.strip() for c in x.children))
        if not own or not x.length:
            continue
        text = text_of(x)
        points = (1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)) * (1 - link_density(x))
        up, part = x.parent if x.tag in PARAGRAPHS and x.parent is not None else x, 1.0
        while up is not None and part > 0.05:
            up.score += points * part
            containers[id(up)] = up
            up, part = up.parent, part / 2
    if not containers:
        return []

    def total(x: Node) -> float:
        kind = 25 if x.tag in ("article", "main") else 5 if x.names & KIND else 0
        return (x.score + kind) * (1 - link_density(x))

    best = max(containers.values(), key=total)
    if best.parent is None:
        return [best]
    least = max(10.0, total(best) * 0.2)
    whole = best.tag in ("article", "main")  # says itself where the article ends

    def goes_along(c: Node | str, top: bool) -> bool:
        if isinstance(c, str):
            return not top and bool(c.strip())
        if not c.length or link_density(c) >= 0.3:
            return False
        if c.tag in INLINE:
            return not top
        return any(x.tag in HEADINGS or x.tag in PARAGRAPHS for x in below(c))

    def beside(c: Node | str, top: bool) -> bool:
        if not whole and goes_along(c, top):
            return True
        if isinstance(c, str):
            return False
        return id(c) in containers and c.tag not in INLINE and total(c) >= least and link_density(c) < 0.3 or c.tag == "p" and c.length > 80 and link_density(c) < 0.25

    out = _with(best, [best], beside)
    at = best.parent
    while not whole and at.tag not in TOP and at.tag not in ("article", "main"):
        above = at.parent
        if above.tag in TOP:  # the page's own blocks: only headings and paragraphs beside the article's wrapper
            return _with(at, out, lambda c, top: not isinstance(c, str) and (c.tag in HEADINGS or c.tag == "p") and goes_along(c, top))
        out, at = _with(at, out, goes_along), above
    return out


def _with(node: Node, nodes: list[Node], beside) -> list[Node]:
    """``nodes``, which stand for ``node``, between those of its siblings for which ``beside`` holds."""
    top, out = node.parent.tag in TOP, []
    for c in node.parent.children:
        if c is node:
            out += nodes
        elif beside(c, top):
            if isinstance(c, str):
                text, c = c, Node("span", {}, node.parent)
                c.children.append(text)
            out.append(c)
    return out


def main_text(html: str | None) -> str:
    """The article's text of one page; empty if there is none."""
    if not html:
        return ""
    root = parsed(html)
    pruned(root)
    measured(root)
    return " ".join(t for t in map(text_of, main_nodes(root)) if t)


def extracted(html: str | Column) -> Column:
    @F.pandas_udf("string")
    def each(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return each(html)


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each page, from the whole html.

    Null and empty pages have empty texts, repeated rows equal ones; nulls in other columns
    are passed on, other columns are not read.
    """
    out = pages.select("page_id", "url", extracted(whole_text("html")).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
