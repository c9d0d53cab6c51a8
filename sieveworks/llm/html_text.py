"""Main text of web pages by composite text density.

A page becomes a tree. For every node, composite text density is its characters per tag,
adjusted by how much of its and the body's text stands in links; a node's density sum is the sum
over its children. The subtree of the largest density sum holds the article. The least density on
the path from it up to the body is the threshold: nodes of the subtree below it that are mostly
link text are navigation and go.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, mapped, table

# fixed values: elements by role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noembed noframes iframe xmp".split())
GONE = frozenset(
    "head script style noscript template iframe object embed svg math canvas audio video map nav menu aside footer form button select option input textarea label fieldset dialog title noembed noframes".split()
)
BLOCK = frozenset(
    "address article blockquote body caption center dd details dir div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
ARTICLE = frozenset(("article", "main"))
FLOW = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote figure table b i em strong span a br center".split())
#: What a start tag closes, and the elements that stop the search for it.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",))}
SCOPE = frozenset("html body table td th caption button article section div main aside nav header footer form blockquote li".split())
#: Words of class, id and role that mark what is not the article.
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination sidebar sidebars aside complementary footer header masthead topbar "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist respond replies disqus discussion reactions share sharing social related recommended recommendations widget widgets toolbar contentinfo form search skip".split()
)
#: Of these, the words that count in a paragraph, too; the others mark containers only.
NOT_TEXT = frozenset("ad ads adv advert adverts advertisement advertising sponsored cookie cookies consent".split())
#: A marked container that holds this share of the page's text is its article whatever it is called.
MOST_TEXT = 0.8
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element: its children are nodes and texts."""

    __slots__ = ("tag", "kids", "chars", "tags", "link_chars", "link_tags", "density", "total", "gone", "named")

    def __init__(self, tag: str, gone: bool = False, named: bool = False):
        # gone: not wanted; named: only by words of class, id or role
        self.tag, self.gone, self.named = tag, gone, named
        self.kids: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _unwanted(tag: str, attributes: str, inside_article: bool) -> tuple[bool, bool]:
    """Whether an element is not wanted, and whether only words of its class, id or role say so."""
    if tag in GONE or tag == "header" and not inside_article:
        return True, False
    if not attributes or tag in ("html", "body"):
        return False, False
    named = False
    for name, *values in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden":
            return True, False
        if name in ("class", "id", "role"):
            words = {w.lower() for w in SPLIT.split(html.unescape("".join(values)))} & (NOT_TEXT if tag in FLOW else NOT_ARTICLE)
            # an article that is named after its header or its form is an article still
            named |= bool(words) and tag not in ARTICLE and not (inside_article and words <= {"header", "form"})
        elif name == "style" and HIDDEN.search("".join(values)) or name == "aria-hidden" and "".join(values).lower() == "true":
            return True, False
    return named, named


def _spare(root: Node) -> None:
    """Containers that only their names mark are wanted if they hold most of the page's text."""
    nodes, todo = [], [root]
    while todo:
        n = todo.pop()
        nodes.append(n)
        todo.extend(k for k in n.kids if isinstance(k, Node) and (not k.gone or k.named))
    held: dict[int, int] = {}
    for n in reversed(nodes):
        held[id(n)] = sum(len(k) - k.count(" ") - k.count("\n") if isinstance(k, str) else held.get(id(k), 0) for k in n.kids)
    for n in nodes:
        if n.named and held[id(n)] >= MOST_TEXT * held[id(root)]:
            n.gone = False


def parse(page: str) -> Node:
    """The tree of a page, with the end tags that HTML leaves out; unknown end tags are passed over."""
    root = Node("body")
    stack, depth = [root], 0  # depth: articles open
    at, end = 0, len(page)

    def text(raw: str) -> None:
        if raw:
            stack[-1].kids.append(html.unescape(raw) if "&" in raw else raw)

    def pop_to(i: int) -> None:
        nonlocal depth
        for node in stack[i:]:
            depth -= node.tag in ARTICLE
        del stack[i:]

    def implied(tags, stops) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                pop_to(i)
                return
            if stack[i].tag in stops:
                return

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = TOKEN.match(page, lt)
        if not m or m[3] and m.end() == end and page[-1] != ">":
            m = LOOSE.match(page, lt) or m  # a quote that never closes
        if not m:
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        if m.lastindex and m.re is TOKEN and m[1] is not None:
            text(m[1])
            continue
        closing, name, attributes = (m[2], m[3], m[4]) if m.re is TOKEN else (m[1], m[2], m[3])
        if name is None:
            continue
        tag = name.lower()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    pop_to(i)
                    break
                if tag not in BLOCK and stack[i].tag in SCOPE:
                    break
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            implied(("p",), SCOPE)
            if tag[0] == "h" and len(tag) == 2 and tag != "hr" and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                pop_to(len(stack) - 1)
        if tag in IMPLIED:
            implied(*IMPLIED[tag])
        node = Node(tag, *_unwanted(tag, attributes, depth > 0))
        stack[-1].kids.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if not node.gone:
                node.kids.append(page[at : close.start() if close else end])
            at = close.end() if close else end
        elif tag not in VOID and not attributes.rstrip().endswith("/") or tag not in VOID and tag in BLOCK:
            stack.append(node)
            depth += tag in ARTICLE
    _spare(root)
    return root


def _order(root: Node) -> list[Node]:
    """Wanted nodes, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(k for k in reversed(node.kids) if isinstance(k, Node) and not k.gone)
    return out


def measure(root: Node) -> list[Node]:
    """Counts and densities of all wanted nodes; returned parents first."""
    nodes = _order(root)
    for n in reversed(nodes):
        n.chars = sum(len(k) - k.count(" ") - k.count("\n") for k in n.kids if isinstance(k, str))
        for k in n.kids:
            if isinstance(k, Node) and not k.gone:
                n.chars += k.chars
                n.tags += k.tags + 1
                n.link_chars += k.link_chars
                n.link_tags += k.link_tags + (k.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars
    share = root.link_chars / root.chars if root.chars else 0.0
    for n in reversed(nodes):
        c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
        if c:
            base = math.log(c * n.link_chars / max(1, c - n.link_chars) + share * c + math.e)
            n.density = max(0.0, c / t * math.log(max(1.0, c * t / (lc * lt)) + 1e-12) / math.log(max(base, 1.0) + 1.0 + 1e-12))
        n.total = sum(k.density for k in n.kids if isinstance(k, Node) and not k.gone)
    return nodes


def main_node(root: Node) -> tuple[Node, float]:
    """The wanted subtree of the largest density sum, and the threshold: the least density on its path to the body.

    Equal sums: the outer, then the earlier. If an article or main element holds the choice, the outermost such
    element is taken. Else the choice widens to the child of the body that holds it, together with the body's own
    texts, headings and paragraphs, and with containers that have no link, or reach the threshold and have less
    than a third of their text in links."""
    nodes = measure(root)
    parent = {id(k): n for n in nodes for k in n.kids if isinstance(k, Node)}
    best = root
    for n in nodes:
        if n.total > best.total * (1 + 1e-12):
            best = n
    path, line, n = [best.density], [best], best
    while (up := parent.get(id(n))) is not None:
        path.append(up.density)
        line.append(up)
        n = up
    limit = min(path)
    if articles := [x for x in line if x.tag in ARTICLE]:
        return articles[-1], limit
    if best is root:
        return root, limit
    own = line[-2]
    around = Node("body")
    around.kids = [k for k in root.kids if isinstance(k, str) or k is own or k.tag in FLOW or not k.link_chars or k.density >= limit and 3 * k.link_chars < k.chars]
    return around, limit


def blocks(node: Node, limit: float) -> list[str]:
    """Texts of the subtree's blocks in page order, white space made single."""
    out: list[str] = []
    piece: list[str] = []

    def flush() -> None:
        if words := "".join(piece).split():
            out.append(" ".join(words))
        piece.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        k = todo.pop()
        if k is None:
            flush()
        elif isinstance(k, str):
            piece.append(k)
        elif k.gone:
            if k.tag in BLOCK or k.tag in ("aside", "nav", "footer", "form", "menu", "dialog"):
                flush()
        elif k.tag in ("br", "wbr", "hr", "img"):
            if k.tag == "hr":
                flush()
            elif k.tag == "br":
                piece.append(" ")
        else:
            if k is not node and k.tag in ("ul", "ol", "div", "section", "table", "dl", "p") and k.density < limit and k.chars and k.link_chars > 0.8 * k.chars and k.link_tags > 1:
                flush()
                continue
            block = k.tag in BLOCK
            if block:
                flush()
                todo.append(None)
            todo.extend(reversed(k.kids))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article of a page as blocks joined by two line ends; empty for null, empty and textless pages."""
    if not page:
        return ""
    node, limit = main_node(parse(page))
    return "\n\n".join(blocks(node, limit))


def extract(pages: DataFrame, *, source: str = "html") -> tuple[DataFrame, str]:
    """pages with one column more, and its name: the main text, never null.

    Whole pages are read, whatever their length. Every row is kept, repeated rows too; columns of
    pages keep their names, ours gives way."""
    name = fresh("main_text", pages.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                texts = [main_text(x) for x in part.column(source).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, name])

    return mapped(pages, run, T.StructType([*pages.schema.fields, T.StructField(name, T.StringType())])), name


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars: one row for every page, repeated ones too; null, empty and textless pages have an empty text."""
    out, name = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col(name).alias("text"), F.length(name).cast("long").alias("n_chars"))
