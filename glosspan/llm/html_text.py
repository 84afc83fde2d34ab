"""Main-text extraction by composite text density.

Each page becomes a small DOM.  Every node gets a link-adjusted density of characters per tag; text that stands in a
block beside other blocks is a nameless block of its own.  The node whose blocks' densities sum highest is the body of
the article.  The lowest density on its path to (not at) the page's body, times ``SLACK``, is the threshold by which the
other children of its enclosing nodes join it (if their sums are a ``SHARE`` of the largest), with the headings just
before them; tags and class names do not choose.
What its own markup declares to be a menu, advert, notice, form, comment and the like has no density and is left out
wherever it is, unless it encloses the page's text: if nearly nothing else is left, the largest such wrapper counts.

Defined cases: null and empty html give an empty text; text without any tag is one block; unclosed, misnested
and cut-off markup is closed where a browser would; a page without visible text gives an empty text; of nodes with
equal sums the outermost, then the first is taken; repeated rows are extracted each for itself; pages of any length are
read whole; an empty table gives no rows; other columns, whatever their names (``text`` or ``n_chars`` too), are not read
unless ``keep`` names them.
"""

from __future__ import annotations

import html as _html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, slices, table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in _RAW}
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
_HEAD_ONLY = frozenset("head meta link title style script base noscript template".split())
#: A start tag of the key closes an open element of the set, unless one of the barriers comes first.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr"}, {"table"}), "tfoot": ({"tbody", "thead", "tr"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_SCOPE = frozenset("table td th caption button article section aside nav main div form body html".split())

#: Share of the lowest density on the body path that a joining block needs.
SLACK = 0.5
#: Share of the largest sum that a joining block's own needs, so that a long line of boilerplate does not join.
SHARE = 0.25
#: A page with less than this share of its characters outside declared pieces is looked at again.
ENCLOSED = 0.1
_DROP_TAGS = frozenset(
    "head script style noscript template nav aside footer button select option input textarea iframe object embed "
    "svg canvas menu dialog search audio video map datalist xmp noframes".split())
_DROP_ROLES = frozenset("navigation banner complementary contentinfo search form menu menubar dialog alert".split())
_DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices sidebar sidenav menu menus navbar nav navigation breadcrumb breadcrumbs footer comment "
    "comments respond replies disqus share sharing social related recommended recommendations newsletter subscribe signup "
    "login popup modal overlay pagination pager masthead toolbar widget skip".split())
_DROP_PAIRS = re.compile(r"side[-_ ]?bar|ad[-_]?(?:slot|unit|box|block|banner|container|wrapper)|site[-_]?(?:header|footer|nav)|page[-_]?(?:header|footer)|top[-_]?bar|user[-_]?comments?")


class _Node:
    __slots__ = ("tag", "attrs", "parent", "items", "chars", "tags", "link_chars", "link_tags", "density", "loose", "drop", "soft")

    def __init__(self, tag: str, attrs: str, parent: _Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.items: list = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density, self.loose = 0.0, 0.0  # of the whole, and of the text that is in no block below
        self.drop = self.soft = False


def parse(text: str) -> _Node:
    """The DOM below one body node; raw-text elements keep no content."""
    root = _Node("body", "", None)
    stack, at, end = [root], 0, len(text)
    while at < end:
        m = _TOKEN.search(text, at)
        if not m:
            stack[-1].items.append(text[at:])
            break
        if m.start() > at:
            stack[-1].items.append(text[at:m.start()])
        at = m.end()
        if m[1]:
            _close(stack, m[1].lower())
            continue
        name, attrs = (m[2], m[3]) if m[2] else (m[4], m[5])
        if not name:
            continue
        tag = name.lower()
        if tag in ("html", "body"):
            if stack[-1].tag == "head":
                stack.pop()
            continue
        if stack[-1].tag == "head" and tag not in _HEAD_ONLY:
            stack.pop()
        if tag in _CLOSES_P:
            _close_until(stack, {"p"}, _SCOPE)
        if tag in _IMPLIED:
            _close_until(stack, *_IMPLIED[tag])
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" and re.fullmatch("h[1-6]", stack[-1].tag):
            stack.pop()
        node = _Node(tag, attrs or "", stack[-1])
        stack[-1].items.append(node)
        if tag in _RAW:
            stop = _RAW_END[tag].search(text, at)
            at = stop.end() if stop else end
        elif tag not in _VOID and not (attrs or "").endswith("/"):
            stack.append(node)
    return root


def _close(stack: list[_Node], tag: str) -> None:
    inline = tag not in _BLOCK
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if inline and stack[i].tag in _BLOCK and tag != "head":
            return
        if tag == "p" and stack[i].tag in _SCOPE:
            return


def _close_until(stack: list[_Node], tags: set[str], barriers) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in barriers:
            return


def _declared(node: _Node, in_article: bool) -> tuple[bool, bool]:
    """Whether the node's own markup says that it is not part of an article, and whether that may be overruled."""
    tag = node.tag
    if tag in _DROP_TAGS:
        return True, False
    soft = tag == "form" or tag == "header" and not in_article
    for m in _ATTR.finditer(node.attrs) if node.attrs else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            soft = soft or tag not in ("article", "main", "body") and bool(not _DROP_WORDS.isdisjoint(re.split(r"[^a-z0-9]+", value)) or _DROP_PAIRS.search(value))
        elif key == "role":
            soft = soft or value in _DROP_ROLES
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False
    return soft, soft


def _ordered(root: _Node) -> list[_Node]:
    """All nodes that are not declared away for good, parents first; nodes inside a dropped one too."""
    out, todo = [], [(root, False, False)]
    while todo:
        node, inside, gone = todo.pop()
        out.append(node)
        inside = inside or node.tag in ("article", "main")
        for x in node.items:
            if isinstance(x, _Node):
                x.drop, x.soft = _declared(x, inside)
                if x.soft or not x.drop:
                    todo.append((x, inside, gone or x.drop))
    return out


def _enclosing(nodes: list[_Node], root: _Node) -> None:
    """Undo declarations that enclose the page's text (a wrapper of class ``has-sidebar``, a page inside a form)."""
    if not any(n.soft for n in nodes):
        return
    whole = {id(n): sum(len(x.strip()) for x in n.items if isinstance(x, str)) if n.tag != "a" else 0 for n in nodes}
    marks = {id(n): n.tag in ("article", "main", "h1") for n in nodes}
    pars = {id(n): int(n.tag == "p") for n in nodes}
    for n in reversed(nodes):
        if n is not root:
            for table in (whole, pars):
                table[id(n.parent)] += table[id(n)]
            marks[id(n.parent)] |= marks[id(n)]
    while True:
        left, todo = whole[id(root)], [root]
        dropped: list[_Node] = []
        while todo:
            for x in todo.pop().items:
                if isinstance(x, _Node) and id(x) in whole:
                    if x.drop:
                        dropped.append(x)
                        left -= whole[id(x)]
                    else:
                        todo.append(x)
        wrappers = [x for x in dropped if marks[id(x)] or pars[id(x)] > 2]
        if left >= ENCLOSED * whole[id(root)] or not wrappers:
            return
        max(wrappers, key=lambda x: whole[id(x)]).drop = False


def measure(root: _Node) -> list[_Node]:
    """Count characters, tags, link characters and link tags below each node and set its composite density."""
    every = _ordered(root)
    _enclosing(every, root)
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo.extend(x for x in reversed(node.items) if isinstance(x, _Node) and not x.drop)
    loose = {}
    for node in nodes:
        node.chars = sum(len(x.strip()) for x in node.items if isinstance(x, str))
    for node in reversed(nodes):
        own = sum(len(x.strip()) for x in node.items if isinstance(x, str))
        inline = [x for x in node.items if isinstance(x, _Node) and not x.drop and x.tag not in _BLOCK]
        loose[id(node)] = (own + sum(x.chars for x in inline), sum(x.tags + 1 for x in inline), sum(x.link_chars for x in inline), sum(x.link_tags for x in inline))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        parent = node.parent
        if parent is not None and node is not root:
            parent.chars += node.chars
            parent.tags += node.tags + 1
            parent.link_chars += node.link_chars
            parent.link_tags += node.link_tags
    ratio = root.link_chars / root.chars if root.chars else 0.0
    for node in nodes:
        node.density = composite(node.chars, node.tags, node.link_chars, node.link_tags, ratio)
        if node.tag in _BLOCK:
            node.loose = composite(*loose[id(node)], ratio)
    return nodes


def composite(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    """Characters per tag, less the more of both are links; ``ratio`` is the page's share of link characters."""
    if not chars:
        return 0.0
    t, lc, lt = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + ratio * chars + math.e)
    argument = max(chars / lc * t / lt, 1.0)
    return chars / t * math.log(argument) / max(math.log(base), 1.0)


def _kept(root: _Node, nodes: list[_Node]) -> tuple[set[int], dict[int, float]]:
    """Ids of the nodes to take whole, and the nodes of the body path with the density their own text needs."""
    best, most, sums = root, -1.0, {}
    for node in nodes:
        if node.tag in _BLOCK:
            sums[id(node)] = total = node.loose + sum(x.density for x in node.items if isinstance(x, _Node) and not x.drop and x.tag in _BLOCK)
            if total > most:
                best, most = node, total
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    need = SLACK * min((n.density for n in path[:-1]), default=0.0)
    whole = {id(best)}
    for below, node in zip(path, path[1:]):
        blocks = [x for x in node.items if isinstance(x, _Node) and not x.drop and x.tag in _BLOCK and x.chars]
        joins = [x is below or x.density >= need and sums[id(x)] >= SHARE * most for x in blocks]
        for k in range(len(blocks) - 2, -1, -1):
            joins[k] = joins[k] or joins[k + 1] and re.fullmatch("h[1-6]", blocks[k].tag) is not None
        whole |= {id(x) for x, yes in zip(blocks, joins) if yes and x is not below}
    return whole, {id(n): max(need, SHARE * most) for n in path[1:]}


def main_text(page: str) -> str:
    root = parse(page)
    nodes = measure(root)
    if not root.chars:
        return ""
    whole, path = _kept(root, nodes)
    blocks: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = " ".join(_html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            blocks.append(text)

    todo: list = [(root, id(root) in whole)]
    while todo:
        x, inside = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            if inside:
                parts.append(x)
        elif x.drop:
            if x.tag in _BLOCK:
                flush()
        elif x.tag == "br":
            parts.append(" ")
        else:
            block = x.tag in _BLOCK
            if block:
                inside = inside or id(x) in whole
                if not inside and id(x) not in path:
                    continue
                flush()
                todo.append((None, inside))
            loose = inside or block and x.loose >= path[id(x)] > 0  # text of an enclosing node joins as its other children do
            todo.extend((y, inside if isinstance(y, _Node) and y.tag in _BLOCK else loose) for y in reversed(x.items))
    flush()
    return "\n".join(blocks)


def extract(pages: DataFrame, id_column: str = "page_id", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Add ``text`` and ``n_chars`` to each page; nothing is shuffled."""
    names = [id_column, *keep]
    schema = ", ".join(f"`{n}` {pages.schema[n].dataType.simpleString()}" for n in names) + ", text string, n_chars long"

    def run(batch: pa.RecordBatch):
        for part in slices(batch, "html"):
            texts = [main_text(h) if h else "" for h in part.column("html").to_pylist()]
            yield pa.table([*(part.column(n) for n in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                           names=[*names, "text", "n_chars"])

    return map_batches(pages.select(*names, F.coalesce("html", F.lit("")).alias("html")), run, schema)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
