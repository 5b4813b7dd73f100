"""HTML extraction by tree scoring.

A page is read into a tree by a tolerant parser. Paragraph-like blocks earn
points for length and commas, discounted by link density, and pass them to
their ancestors: all to the parent, half to the grandparent, less further up.
If the best container lies inside an article (by its element or its own name),
that article is kept whole; else it is kept with siblings that score or read alike;
parts that are never the main text (menus, headers of the page, footers,
adverts, forms, comments and the like) are cut before, by element or by name.

Everything inside the kept nodes is returned: headings, lists, tables, quotes.
Character references are decoded; white space inside a block becomes one
space; blocks are joined by one space, in page order.

Defined results: null and empty html give the empty string, as do pages
without text; repeated rows are extracted one by one; broken, unclosed and
deeply nested markup is read as far as it goes: a quote that is not closed ends
with its tag, a comment that is not closed with the next ``>``; very long pages
are read whole, in time that grows with their length. An input column named
main_text is replaced; all others stay.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._bpe import frugal
from ._store import small_batches

#: Elements without content, and raw-text elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noframes xmp svg math canvas object".split())
#: Elements that end a block before and after them.
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is paragraph-like and earns points.
SCORED = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6 div section article".split())
#: Small blocks that read on with a text beside them.
BLOCK_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure br hr".split())
#: Never part of the main text, but for forms that hold it.
DROPPED = frozenset("nav footer aside form button select input label dialog menu head script style noscript template textarea iframe svg canvas object math audio video".split())
#: Names (class, id, role) of parts that are never the main text, and of parts that are not unless named as such too.
EDGE, END = r"(?:^|[\s_-])(?:", r")(?=$|[\s_-])"
NEVER = re.compile(
    EDGE + r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|nav\w*|menus?|breadcrumbs?|sidebars?|footers?|topbar|toolbar|comments?|commentlist|disqus|respond|repl(?:y|ies)|"
    r"cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|subscribe|subscription|signup|login|pagination|pager|complementary|contentinfo|navigation" + END
)
SELDOM = re.compile(EDGE + r"banner|side|headers?|masthead|share|sharing|social|related|recommend\w*|widgets?|search|skip|toc|tags?" + END)
#: Names of parts that stand inside an article and are none of it, unless they hold paragraphs.
BESIDES = re.compile(EDGE + r"share|sharing|social|related|recommend\w*|widgets?" + END)
#: Names (class, id, role) that say that an element is the whole article.
WHOLE = frozenset("article post entry story hentry main-article main-content".split())
INSIDE = re.compile(EDGE + r"article|main|content|post|entry|story|body|text" + END)
#: Class names that tell of a layout or a state, not of the part itself: such a name counts up to there.
LAYOUT = re.compile(r"(?:^|[_-])(?:has|with|without|no|is|not)[_-].*$|[^\s_-]+[_-](?:open|closed|enabled|disabled|allowed|off|on)$")
#: Characters of paragraphs that make a form part of the text: some pages stand in one form as a whole.
FORM_PROSE = 400
#: Start tags that close an open element of these names.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
}
SCOPE = frozenset("ul ol dl table body html article section div td th tr select".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A quoted value ends before white space, ``/`` or ``>``, or holds no angle brackets; else its quote is a stray one.
VALUE = r"""[^>"']|"[^"<>]*"|'[^'<>]*'|"[^"]{0,20000}"(?=[\s/>])|'[^']{0,20000}'(?=[\s/>])"""
TOKEN = re.compile(rf"(<!--)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)(?:((?:{VALUE})*+)(?:>|$)|([^>]*)(?:>|$))", re.S)
ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?![\w-])\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "items", "names", "score", "chars", "linked", "commas", "holds", "prose")

    def __init__(self, tag: str, parent: "Node | None", names: str = ""):
        self.tag, self.parent, self.names = tag, parent, names
        self.items: list["Node | str"] = []
        self.score = 0.0
        self.chars = self.linked = self.commas = self.prose = 0
        self.holds = False


def _names(attributes: str) -> str | None:
    """class, id and role in lower case; None if the element is hidden."""
    found = []
    for m in ATTR.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and HIDDEN.search(value)):
            return None
        if key in ("class", "id", "role"):
            found.append(value.lower())
    return " ".join(found)


def parse(page: str) -> Node:
    """The page's tree, without the parts that are never main text."""
    root = Node("#root", None)
    at, here, skipping = 0, root, ""
    depth_of: dict[str, int] = {}
    pos, lower = 0, None
    last_comment_end = page.rfind("-->")
    while True:
        m = TOKEN.search(page, pos)
        if m is None:
            break
        if m.start() > at:
            here.items.append(_html.unescape(page[at : m.start()]))
        at = pos = m.end()
        if m[1]:
            closed = last_comment_end >= m.start() + 2
            end = page.find("-->" if closed else ">", m.start() + 2)
            at = pos = len(page) if end < 0 else end + (3 if closed else 1)
        elif m[3]:
            tag, attributes = m[3].lower(), m[4] if m[4] is not None else m[5]
            if tag in RAW and not attributes.endswith("/"):
                lower = lower or page.lower()  # only ASCII letters matter, and lower() may change lengths
                if len(lower) != len(page):
                    lower = page.translate(ASCII_LOWER)
                end = lower.find(f"</{tag}", pos)
                if end < 0:
                    at = pos = len(page)
                else:
                    stop = page.find(">", end)
                    at = pos = len(page) if stop < 0 else stop + 1
                continue
            if tag in CLOSES_P and depth_of.get("p"):
                here = _close(here, ("p",), depth_of, SCOPE - {"div"})
            if tag in CLOSES:
                here = _close(here, CLOSES[tag], depth_of, SCOPE - set(CLOSES[tag]) - {"tr" if tag == "tr" else ""})
            if tag in VOID:
                if tag in ("br", "hr"):
                    here.items.append(Node(tag, here))
                continue
            names = _names(attributes) if attributes else ""
            node = Node(tag, here, "#hidden" if names is None else names)
            here.items.append(node)
            if not attributes.endswith("/"):
                here = node
                depth_of[tag] = depth_of.get(tag, 0) + 1
        elif m[2]:
            tag = m[2].lower()
            if depth_of.get(tag):
                while here.tag != tag:
                    depth_of[here.tag] -= 1
                    here = here.parent
                depth_of[tag] -= 1
                here = here.parent
            elif tag == "br":
                here.items.append(Node("br", here))
    if at < len(page):
        here.items.append(_html.unescape(page[at:]))
    return root


ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def _close(here: Node, tags: tuple[str, ...], depth_of: dict[str, int], scope: frozenset | set) -> Node:
    """Closes up to the nearest open element of ``tags`` unless a scope boundary lies between."""
    node = here
    while node.parent is not None:
        if node.tag in tags:
            while here is not node:
                depth_of[here.tag] -= 1
                here = here.parent
            depth_of[node.tag] -= 1
            return node.parent
        if node.tag in scope:
            return here
        node = node.parent
    return here


def _look_inside(root: Node) -> None:
    """For each node, whether it is or holds an article or main element, and the characters of its paragraphs: one pass, children first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.items if not isinstance(x, str)]
    for node in reversed(order):
        node.holds |= node.tag in ("article", "main")
        if node.tag in ("p", "pre", "blockquote"):
            node.prose = sum(len(x.strip()) for x in node.items if isinstance(x, str)) + sum(len(x.strip()) for y in node.items if not isinstance(y, str) and y.tag != "a" for x in y.items if isinstance(x, str))
        if node.parent is not None:
            node.parent.holds |= node.holds
            node.parent.prose += node.prose if node.tag not in DROPPED or node.tag == "form" else 0


def _is_whole(node: Node) -> bool:
    """Whether an element says of itself that it is an article."""
    return node.tag in ("article", "main") or (bool(node.names) and not WHOLE.isdisjoint(node.names.split()))


def _beside(node: Node, in_article: bool) -> bool:
    """Whether a node is no part of the main text: by its element, or by its names unless it holds an article itself."""
    if node.tag == "form" and node.names != "#hidden":
        if not node.holds and node.prose < FORM_PROSE:
            return True
    elif node.tag in DROPPED or node.names == "#hidden":
        return True
    if node.tag == "header" and not in_article and not _is_whole(node.parent):
        return True
    if not node.names or node.tag in ("html", "body", "article", "main"):
        return False
    if not NEVER.search(node.names) and not SELDOM.search(node.names):
        return False
    names = " ".join(LAYOUT.sub("", t) for t in node.names.split())
    if in_article and not node.prose and BESIDES.search(names) and not INSIDE.search(names):
        return not node.holds
    if NEVER.search(names) or (not in_article and SELDOM.search(names) and not INSIDE.search(names)):
        return not node.holds
    return False


def _postorder(root: Node) -> list[Node]:
    """Kept nodes, children before parents. Nodes beside the main text are taken out."""
    _look_inside(root)
    order, stack = [], [(root, False)]
    while stack:
        node, in_article = stack.pop()
        order.append(node)
        inner = in_article or node.tag in ("article", "main")
        node.items = [x for x in node.items if isinstance(x, str) or not _beside(x, inner)]
        stack += [(x, inner) for x in node.items if not isinstance(x, str)]
    return order[::-1]


def _measure(order: list[Node]) -> None:
    """Characters, linked characters and commas of each node, and the points that paragraphs pass up."""
    for node in order:
        own = 0
        for x in node.items:
            if isinstance(x, str):
                n = len(x.strip())
                own += n
                node.chars += n
                node.commas += x.count(",") + x.count("、") + x.count("，")
            else:
                node.chars += x.chars
                node.linked += x.linked
                node.commas += x.commas
        if node.tag == "a":
            node.linked = node.chars
        inline = all(isinstance(x, str) or x.tag not in BLOCK or x.tag == "br" for x in node.items)
        if node.tag in SCORED and node.chars and (inline or own > 25):
            points = (1 + node.commas + min(node.chars / 100, 3)) * (1 - node.linked / node.chars)
            up, share = node.parent, 1.0
            while up is not None and share > 0.1:
                up.score += points * share
                up, share = up.parent, share / 2 if share == 1.0 else share / 3
    for node in order:
        density = node.linked / node.chars if node.chars else 1.0
        if node.tag in ("article", "main") or (node.names and INSIDE.search(node.names)):
            node.score = node.score * 1.5 + 25
        node.score *= 1 - density


def best_nodes(root: Node) -> list[Node | str]:
    """The best container and the siblings that belong to it, in page order."""
    order = _postorder(root)
    _measure(order)
    holders = [x for x in order if x.tag in ("article", "main", "section", "div", "td", "body", "blockquote", "#root") and x.chars]
    if not holders:
        return [root]
    best = max(reversed(holders), key=lambda x: x.score)  # of equals the outermost
    if best.tag in ("body", "#root"):  # nobody has set the text apart: lists of links are menus
        best.items = [x for x in best.items if isinstance(x, str) or x.tag not in ("ul", "ol", "dl") or x.linked < 0.8 * x.chars]
    around = best
    while around is not None and not _is_whole(around):
        around = around.parent
    if around is not None and around is not best:  # an article is kept whole: its title and sections may stand beside the best part
        return [around]
    if best.parent is None:
        return [best]
    limit = max(10.0, best.score * 0.2)
    items = best.parent.items
    kept = []
    for n, x in enumerate(items):
        if isinstance(x, str):
            continue
        density = x.linked / x.chars if x.chars else 1.0
        alike = bool(best.names) and x.names == best.names and x.tag == best.tag
        prose = x.tag == "p" and density < 0.25 and x.chars > 80
        if x is best or (x.chars and x.tag not in ("ul", "ol") and (x.score + (best.score * 0.2 if alike else 0) >= limit and density < 0.5)) or prose:
            kept.append(n)
    if best.tag not in ("article", "main"):  # those say themselves where the text ends
        low, high = kept[0], kept[-1]
        while low > 0 and _joins(items[low - 1]):
            low -= 1
        while high + 1 < len(items) and _joins(items[high + 1]):
            high += 1
        sure = set(kept)
        kept = [n for n in range(low, high + 1) if n in sure or _joins(items[n])]
    return [items[n] for n in kept]


def _joins(x: Node | str) -> bool:
    """Whether a small sibling between or directly around kept ones reads on with them: text, a heading, a list, a short paragraph."""
    if isinstance(x, str):
        return True
    small = x.tag in BLOCK_TEXT or x.tag not in BLOCK
    return small and (not x.chars or x.linked < 0.25 * x.chars)


def render(nodes: list[Node | str]) -> str:
    """Text of the nodes: inline text runs on, blocks are parted by a space."""
    out: list[str] = []
    stack: list[Node | str] = nodes[::-1]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.tag in BLOCK:
            out.append(" ")
            stack.append(" ")
        stack += x.items[::-1]
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    return render(best_nodes(parse(page))) if page else ""


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """Replaces the html column of every row by ``main_text``."""
    small_batches(pages.sparkSession)
    source = pages.select(*[c for c in pages.columns if c != "main_text"])
    schema = T.StructType([*[f for f in source.schema.fields if f.name != column], T.StructField("main_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            at = rows.schema.get_field_index(column)
            texts = pa.array([main_text(x.as_py()) for x in rows.column(at)], pa.string())
            kept = [i for i in range(rows.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[rows.column(i) for i in kept], texts], [*[rows.schema.names[i] for i in kept], "main_text"])

    return source.mapInArrow(frugal(run), schema)
