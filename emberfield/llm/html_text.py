"""Main text of web pages by composite text density.

Each node's characters per tag are adjusted for links; a node's sum is that of its children's densities. The node
with the largest sum is the core of the article, and the least density on its path to the body is the threshold at
which neighbours of that path belong to the article too.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
MEDIA = frozenset("object canvas audio video".split())
FOREIGN = frozenset(["svg", "math"])
# Nodes of svg and math that hold HTML again.
POINTS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"br", "option", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
# Where the search for an open p ends.
HOLDS_P = frozenset("p button td th table caption".split()) | MEDIA | FOREIGN
# On these the slash of a start tag means nothing.
UNSLASHED = frozenset("div p span a section article li td".split()) | MEDIA
# Start tags that end svg and math left open.
BREAKOUT = BLOCK | frozenset("b big code em embed font i img listing meta nobr ruby s small span strike strong sub sup tt u var".split())
NEVER = frozenset("head nav header footer aside form button select menu dialog input label fieldset svg".split()) | RAW | MEDIA
CONTAINER = frozenset(["article", "main"])
NAMED = frozenset("article main content post entry story".split())
# Start tags that end open nodes, and the nodes in which these are sought.
ENDS_WITH = {
    name: (frozenset(ended.split()), frozenset(within.split()))
    for name, ended, within in [
        ("li", "li", "ul ol menu dir"), ("dt", "dt dd", "dl"), ("dd", "dt dd", "dl"), ("tr", "tr td th", "table"), ("td", "td th", "tr table"),
        ("th", "td th", "tr table"), ("option", "option", "select"), ("tbody", "thead tbody tr td th", "table"),
    ]
}
SCOPING = frozenset(x for pair in ENDS_WITH.values() for names in pair for x in names)
# Words of class, id and role that mark what is not the article.
ASIDE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus footer header "
    "masthead menu nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related replies reply respond share sharing sidebar skip "
    "social sponsor sponsored subscribe toolbar widget modal alert signup login search contentinfo complementary".split()
)
# A class like "with-sidebar" says what is beside the node, not what it is.
BESIDE = frozenset("no with without has".split())
# Beside these, a word of ASIDE still is all that a class or id says.
NEUTRAL = frozenset(
    "site page main left right top bottom box bar list wrap wrapper container area section block inner outer form link links button buttons panel region "
    "global primary secondary item items group row col column unit slot zone a b c".split()
)
# Headings and paragraphs, often named after what they tell of.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p".split())
# On these an id may say what is not the article; elsewhere it is an anchor.
HOLDERS = frozenset("div section ul ol dl table details center".split())
# A node of a doubtful name stays from this share of the threshold on.
DOUBT = 0.25
OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+))")
COMMENT_END = re.compile("--!?>")
# The end of a tag, or an attribute: its name, then the quote or the bare text of its value.
ATTRIBUTE = re.compile(r"""[\s/]*+(?:>|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:(["'])|([^\s>"'][^\s>]*+)?))?)""")
READ = frozenset("class id role style hidden aria-hidden".split())
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
UNSHOWN = re.compile(r"display\s*:\s*none", re.I)


class Node:
    __slots__ = ("name", "parent", "children", "foreign", "aside", "doubt", "named", "left_open", "slash", "chars", "tags", "link_chars", "link_tags", "density", "sum", "holds", "called")

    def __init__(self, name: str, parent: Node | None, aside: bool = False, named: bool = False):
        self.name, self.parent, self.aside, self.named = name, parent, aside, named
        self.children: list[Node | str] = []
        self.foreign = self.doubt = self.left_open = self.slash = False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.holds = self.called = False


def _marks(name: str, attributes: dict[str, str]) -> tuple[bool, bool, bool]:
    """Do class, id, role or style say that a node is not the article, perhaps is not, or is it?

    A class or id of its own that names the article outweighs others that do not, as in "post comments-open". One word among
    others in an id, or in a class of a section, a heading or a paragraph, only raises doubts: it may be made from a title.
    """
    if not attributes:
        return False, False, False
    aside = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(UNSHOWN.search(attributes.get("style", "")))
    words = [(kind, {x.lower() for x in PARTS.findall(token)}) for kind in ("role", "class", "id") for token in attributes.get(kind, "").split()]
    words = [(kind, w) for kind, w in words if not w & BESIDE]
    own, doubt = any(w & NAMED and not w & ASIDE for _, w in words), False
    for kind, w in words:
        if not w & ASIDE or own and kind != "role":
            continue
        if kind == "role":
            aside = True
        elif name in PROSE:
            doubt |= kind == "class"
        elif kind == "class" and name != "section" or name in HOLDERS and w <= ASIDE | NEUTRAL:
            aside = True
        else:
            doubt |= name in HOLDERS
    return aside, doubt, any(w & NAMED for _, w in words)


def _attributes(page: str, pos: int, last: dict[str, int]) -> tuple[int, dict[str, str], bool] | None:
    """Where a tag ends, the attributes read, and whether it ends with a slash; None if the page ends before it.

    A quote opens a value only after ``=``. One that is never closed, or closed in the midst of a later word after the tag's end,
    is a stray one. ``last`` tells where the last quotes of the page are.
    """
    found: dict[str, str] = {}
    while True:
        m = ATTRIBUTE.match(page, pos)
        if m is None:
            return None
        pos, name, quote, value = m.end(), m[1], m[2], m[3] or ""
        if name is None:
            return pos, found, m[0].endswith("/>")
        if quote:
            close = page.find(quote, pos) if pos <= last[quote] else -1
            stray = close < 0 or page[close + 1: close + 2] not in ("", " ", "\t", "\n", "\r", "\f", "/", ">")
            end = page.find(">", pos, close if close >= 0 else len(page)) if stray else -1
            if end < 0 and close < 0:
                return None
            value, pos = (page[pos:end], end) if end >= 0 else (page[pos:close], close + 1)
        name = name.lower()
        if name in READ:
            found.setdefault(name, value)


def _after_comment(page: str, opened: str, pos: int) -> int:
    if opened == "<!--":
        if page.startswith(">", pos) or page.startswith("->", pos):
            return page.index(">", pos) + 1
        m = COMMENT_END.search(page, pos)
        return m.end() if m else len(page)
    close = "]]>" if opened == "<![CDATA[" else ">"
    end = page.find(close, pos)
    return end + len(close) if end >= 0 else len(page)


def parse(page: str) -> Node:
    """Tree of a page; unclosed and stray tags are put right the way browsers do, roughly. Time is linear in the page's length."""
    root = Node("html", None)
    # Open nodes, each with the place of the p that a block would end, and of the nodes that the tags of ENDS_WITH would end.
    stack: list[tuple[Node, int, dict[str, int]]] = [(root, -1, {})]
    places: dict[str, list[int]] = {}
    last = {quote: page.rfind(quote) for quote in "\"'"}
    media, pos = False, 0

    def end(place: int) -> None:
        while len(stack) > place:
            places[stack.pop()[0].name].pop()

    while True:
        m = OPEN.search(page, pos)
        text = page[pos: m.start() if m else len(page)]
        if text:
            stack[-1][0].children.append(html.unescape(text))
        if m is None:
            break
        pos = m.end()
        if m["name"] is None:
            pos = _after_comment(page, m[0], pos)
            continue
        tag = _attributes(page, pos, last)
        if tag is None:
            break  # cut off by the end of the page
        pos, attributes, slash = tag
        name = m["name"].lower()
        if name == "html":
            continue
        if m["end"]:
            if places.get(name):
                place = places[name][-1]
                stack[place][0].left_open = False
                end(place)
            elif name == "p":
                stack[-1][0].children.append(Node("p", stack[-1][0]))
            continue
        if name in BREAKOUT:
            while stack[-1][0].foreign and stack[-1][0].name not in POINTS:
                end(len(stack) - 1)
        if name in CLOSES_P and stack[-1][1] >= 0:
            end(stack[-1][1])
        if name in ENDS_WITH and name in stack[-1][2]:
            end(stack[-1][2][name])
        at, p, ends = stack[-1]
        aside, doubt, named = _marks(name, attributes)
        node = Node(name, at, aside and name not in ("body", *CONTAINER) or name in NEVER, named or name in CONTAINER)
        node.doubt = doubt and name not in CONTAINER
        node.foreign = name in FOREIGN or at.foreign and at.name not in POINTS
        at.children.append(node)
        ended = slash and (node.foreign or name not in UNSLASHED)
        if name in RAW:
            if not (node.foreign and ended):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, pos)
                pos = close.end() if close else len(page)
        elif name not in VOID and not ended:
            place = len(stack)
            if name in SCOPING:
                ends = {k: v for k, v in ends.items() if name not in ENDS_WITH[k][1]}
                for k, (names, _) in ENDS_WITH.items():
                    if name in names:
                        ends.setdefault(k, place)
            stack.append((node, place if name == "p" else -1 if name in HOLDS_P else p, ends))
            places.setdefault(name, []).append(place)
            if name in MEDIA:
                node.left_open, node.slash, media = True, slash, True
    if media:
        _end_media(root)
    return root


def _end_media(root: Node) -> None:
    """Ends media elements that no tag ended before their first block, or at their slash; the rest belongs to their parents."""
    todo = [root]
    while todo:
        node = todo.pop()
        given, node.children = node.children, []
        # Media left open within each other, and what is still to be read of each.
        owners, reading = [node], [(node, iter(given))]
        while reading:
            of, rest = reading[-1]
            c = next(rest, None)
            if c is None:
                reading.pop()
                if owners[-1] is of and of is not node:
                    owners.pop()
                continue
            if not isinstance(c, Node):
                owners[-1].children.append(c)
                continue
            if c.name in BLOCK:
                del owners[1:]
            c.parent = owners[-1]
            c.parent.children.append(c)
            if c.left_open:
                reading.append((c, iter(c.children)))
                c.children = []
                if not c.slash:
                    owners.append(c)
            else:
                todo.append(c)


def _elements(node: Node):
    return [c for c in node.children if isinstance(c, Node) and not c.aside]


def measure(root: Node) -> list[Node]:
    """Counts, densities and sums of all nodes that may be the article, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(reversed(_elements(node)))
    for node in reversed(order):
        own = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        inner = _elements(node)
        node.chars = own + sum(c.chars for c in inner)
        node.tags = sum(c.tags + 1 for c in inner)
        node.holds = node.named or any(c.holds for c in inner)
        node.called = node.name in CONTAINER or any(c.called for c in inner)
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        else:
            node.link_chars, node.link_tags = sum(c.link_chars for c in inner), sum(c.link_tags for c in inner)
    ratio = root.link_chars / max(root.chars, 1)
    for node in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        base = math.log(c * lc / max(c - node.link_chars, 1) + ratio * c + math.e)
        node.density = c / t * math.log(max(c * t / (lc * lt), 1.0) + 1e-9, max(base, 1 + 1e-9)) if c else 0.0
    for node in order:
        node.sum = sum(c.density for c in _elements(node))
    return order


def article(root: Node) -> tuple[Node, set[int]]:
    """The node to read, and the ids of its descendants to leave out.

    The core is the outermost node on the path from the best one to the body that is, or else is named as, the article; without
    one, the body with its threshold. Neighbours of the core's path that are as dense, or named too, are read with it.
    """
    order = measure(root)
    best = max(order, key=lambda n: n.sum)
    if best.sum <= 0:
        best = max(order, key=lambda n: n.density)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    top = next((k for k, n in enumerate(path) if n.name == "body"), len(path) - 1)
    calls = [k for k, n in enumerate(path) if n.name in CONTAINER]
    named = [k for k, n in enumerate(path[: top + 1]) if n.named and n.name not in ("body", "html")]
    least = min(n.density for n in path[: top + 1])
    on_path = {id(n) for n in path}
    # Names that may be made from a title: density and links decide.
    out = {id(n) for n in order if n.doubt and id(n) not in on_path and (2 * n.link_chars > n.chars or n.density < DOUBT * least)}
    if calls and calls[-1] >= top:
        return path[calls[-1]], out
    path = path[: top + 1]
    core = calls[-1] if calls else named[-1] if named else top
    # What lies in the core is read whole, but for lists of links around the inmost node that is named, and blocks of links beside the best.
    inmost = core if calls else named[0] if named else 0
    reach = core
    if not calls:
        out.update(id(c) for k in range(inmost) for c in _elements(path[k + 1]) if c is not path[k] and c.name in HOLDERS and c.link_tags > 1 and 2 * c.link_chars > c.chars)
    for k in range(inmost, len(path) - 1):
        for c in _elements(path[k + 1]):
            if c is path[k] or not c.chars:
                continue
            dense, links = c.density >= least, 2 * c.link_chars > c.chars
            if calls:
                kept = dense and c.called
            else:
                kept = dense or c.name in PROSE or c.name == "br" or not links and (c.holds or bool(named) and k < core)
            if not kept:
                out.add(id(c))
            else:
                reach = max(reach, k + 1)
    return path[reach], out


def read(node: Node, out: set[int]) -> str:
    """Text of a node in page order, blocks and white space as one space each."""
    parts, stack = [], [node]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            parts.append(at)
        elif at is None:
            parts.append(" ")
        elif not at.aside and id(at) not in out or at is node:
            block = at.name in BLOCK
            if block:
                parts.append(" ")
                stack.append(None)
            stack.extend(reversed(at.children))
    return " ".join("".join(parts).split())


def main_text(page: str | None) -> str:
    """The article of a page; empty if there is none."""
    return read(*article(parse(page))) if isinstance(page, str) and page else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: ``id``, ``url``, ``text``, ``n_chars``.

    A null or empty page, and one without text outside menus and the like, has an empty text. Pages of any length
    are read whole; rows repeated get equal results; an empty table gives an empty one. Other columns are not read.
    """
    text = F.pandas_udf(lambda s: s.map(main_text) if len(s) else pd.Series([], dtype=str), "string")
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text(F.coalesce(F.col(html_col), F.lit(""))).alias("text"))
    return out.select("*", F.char_length("text").cast("long").alias("n_chars"))
