"""HTML extraction by composite text density.

A tolerant parser builds the element tree. Elements that never are main text by their tag or role (scripts,
styles, forms, navigation, page headers and footers, asides, what is hidden) are cut first. A class or id
that says sidebar, notice, comments and the like cuts only what density finds poor: densities are
first taken with all such elements in the tree, and one that holds an <article> or <main>, or the node of the
largest density sum, stays; others go if their sum is under half of the largest (adverts and comments whatever
theirs is). For every remaining node the composite density is

    CTD = C / T * log((C / LC) * (T / LT)) / log(log(C / (C - LC) * LC + LCb / Cb * C + e))

with C characters, T tags, LC characters and LT tags of links (0 counts as 1 in a
denominator) and b the body. A node's density sum adds its children's CTD, and that of its own text where it
stands loose among block elements. From the node
with the largest sum the path to the body gives the threshold, its least CTD. If an
<article> or <main> is on that path, the outermost <article> (else <main>) is the text;
otherwise that node is, with the subtrees and loose texts beside the path whose CTD reaches the threshold.
Within the text only link lists under the threshold are cut; nothing else is.

Text: character references decoded, white space collapsed, block elements and <br> separate
words, inline elements don't.

Defined results: null or empty html, and html without any text, give an empty text of
0 characters. A null id or url stays null. Repeated rows get equal rows; an empty table gives
an empty table; other columns are ignored. Whole pages are parsed, however long or nested.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CUT = frozenset("head script style noscript template iframe object embed svg math canvas audio video form button select option textarea input fieldset dialog nav footer aside menu frameset noembed noframes".split())
RAW = frozenset("script style noscript template iframe textarea title noembed noframes xmp svg math".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status".split())
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot sponsor sponsored sponsors promo promos promotion banner banners "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer footers sidebar sidebars aside header masthead topbar "
    "cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay lightbox newsletter subscribe subscription signup login paywall "
    "share sharing social related recommended recommendations trending comment comments commentlist replies disqus discussion respond widget widgets toolbar skip copyright disclaimer".split()
)
KEEP_WORDS = frozenset("article post entry story title headline content main body".split())
#: What an opening tag closes, if it is open within the given scope.
P_CLOSERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
ALIKE = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>\x00]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>\x00]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Node:
    __slots__ = ("tag", "parent", "children", "cut", "always", "chars", "tags", "link_chars", "link_tags", "ctd", "own", "sum")

    def __init__(self, tag: str, parent: Node | None, cut: int):
        self.tag, self.parent, self.cut, self.always = tag, parent, min(cut, NAMED), cut == NAMED_ALWAYS
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.ctd = self.own = self.sum = 0.0


#: An element that its class or id would cut: ``_judge`` looks at its density. Adverts and comments are no part of the text even if dense.
NAMED, NAMED_ALWAYS = 2, 3
ALWAYS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot sponsor sponsored sponsors comment comments commentlist replies disqus discussion respond cookie cookies consent newsletter".split())


def _cut(tag: str, attrs: str, inside: bool) -> int:
    """Whether an element never is main text: 0, 1, NAMED or NAMED_ALWAYS. inside: it stands in an article."""
    if tag in CUT or tag == "header" and not inside:
        return 1
    if tag in ("html", "body") or not attrs or "=" not in attrs and "hidden" not in attrs:
        return 0
    names: set[str] = set()
    own: set[str] = set()
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            names.update(x.lower() for x in _NAME.findall(value))
            own.update(value.lower().split())
        elif key == "role" and value.lower() in CUT_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return 1
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 1
    found = names & CUT_WORDS
    if tag in ("main", "article"):
        found &= {"comment", "comments", "ad", "advert", "related", "promo", "sponsored"}
    if not found or found <= {"header"} and names & KEEP_WORDS or own & KEEP_WORDS and not own & CUT_WORDS:
        return 0
    return NAMED_ALWAYS if found & ALWAYS else NAMED


def _judge(root: Node) -> None:
    """Cut the elements that bear a cutting name and that density finds poor; keep the others.

    Densities are taken with all of them in the tree. One that holds an <article>, a <main> or the node of the largest sum
    stays. Others go if their sum is under half of the largest one, and adverts and comments (``ALWAYS``)
    whatever theirs is; the largest sum is looked for outside those, unless they hold three quarters of the text.
    """
    nodes = _order(root, NAMED)
    named = [x for x in nodes if x.cut == NAMED]
    if not named:
        return
    _measure(nodes, NAMED)
    holds: set[int] = set()
    for node in reversed(nodes):
        if node.parent is not None and (node.tag in ("article", "main") and not node.always or id(node) in holds):
            holds.add(id(node.parent))
    barred = {id(x) for x in named if x.always and id(x) not in holds and x.chars <= 0.75 * root.chars}
    inside: set[int] = set()
    for node in nodes:
        if id(node) in barred or node.parent is not None and id(node.parent) in inside:
            inside.add(id(node))
    best = max((x for x in nodes if id(x) not in inside), key=lambda x: x.sum)
    path = set()
    up: Node | None = best
    while up is not None:
        path.add(id(up))
        up = up.parent
    for node in named:
        stays = id(node) in holds or id(node) in path or id(node) not in barred and node.sum > 0 and node.sum >= best.sum / 2
        node.cut = 0 if stays else 1
    for node in nodes:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.ctd = node.sum = 0.0


def parse(page: str) -> Node:
    root = body = Node("body", None, 0)
    at, inside, pos, n = body, 0, 0, len(page)
    while pos < n:
        m = _TOKEN.match(page, pos)
        pos = m.end()
        if m["text"]:
            at.children.append(m["text"])
            continue
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, attrs = tag.lower(), m["attrs"] or m["attrs2"] or ""
        if m["end"] or m["end2"]:
            if tag in ("html", "body"):
                continue
            up = at
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                while at is not up.parent:
                    inside -= at.tag == "article"
                    at = at.parent
            elif tag in ("br", "p"):
                at.children.append(Node("br", at, 0))
            continue
        if tag in ("html", "body"):
            while at is not root:  # a body ends an unclosed head
                inside -= at.tag == "article"
                at = at.parent
            continue
        if at.tag == "head" and tag not in ("title", "meta", "link", "base", "script", "style", "noscript", "template"):
            at = at.parent
        closes, scope = ({"p"}, {"table", "td", "th", "button", "object"}) if tag in P_CLOSERS else (set(), set())
        for shut, within in ((closes, scope), ALIKE.get(tag, (set(), set()))):
            up = at
            while shut and up is not root and up.tag not in within:
                if up.tag in shut:
                    while at is not up.parent:
                        inside -= at.tag == "article"
                        at = at.parent
                    up = at
                else:
                    up = up.parent
        node = Node(tag, at, _cut(tag, attrs, inside > 0))
        at.children.append(node)
        if tag in RAW and not attrs.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, pos)
            node.cut = 1
            pos = end.end()
        elif tag not in VOID and not (attrs.rstrip().endswith("/") and tag in ("svg", "path")):
            at = node
            inside += tag == "article"
    _judge(root)
    return root


def _order(root: Node, upto: int = 0) -> list[Node]:
    """The nodes that aren't cut (or, with NAMED, are by name alone), parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [x for x in reversed(node.children) if isinstance(x, Node) and x.cut in (0, upto)]
    return out


def _measure(nodes: list[Node], upto: int = 0) -> None:
    """Counts, composite text densities and density sums of the nodes, parents first."""
    for node in reversed(nodes):
        link = node.tag == "a"
        for x in node.children:
            if isinstance(x, str):
                node.chars += len("".join(x.split()))
            elif x.cut in (0, upto):
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
        if link:
            node.link_chars = node.chars
    body = nodes[0]
    shared = body.link_chars / max(1, body.chars)
    # without links anywhere the base would be 1; it is held at 1.5 at least
    base = lambda c, lc: max(1.5, math.log(c / max(1, c - lc) * lc + shared * c + math.e))
    for node in nodes:
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if c:
            node.ctd = c / t * math.log(max(1.0, c / lc * t / lt)) / math.log(base(c, node.link_chars))
    for node in nodes:
        kids = [x for x in node.children if isinstance(x, Node) and x.cut in (0, upto)]
        node.own = 0.0
        if any(x.tag not in INLINE for x in kids):
            c = sum(len("".join(x.split())) for x in node.children if isinstance(x, str))
            node.own = c * math.log(max(1, c)) / math.log(base(c, 0))
        node.sum = sum(x.ctd for x in kids) + node.own


def _collect(node: Node, threshold: float, out: list[str]) -> None:
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.cut or x is not node and x.link_tags >= 2 and x.tag not in INLINE and x.ctd < threshold and x.link_chars > 0.6 * x.chars:
            out.append(" ")
        else:
            gap = [] if x.tag in INLINE else [" "]
            todo += [*gap, *reversed(x.children), *gap]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes = _order(parse(page))
    _measure(nodes)
    best = max(nodes, key=lambda x: x.sum)
    if best.sum <= 0:
        best = nodes[0]
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(x.ctd for x in path)
    chosen = [x for x in path if x.tag == "article"][-1:] or [x for x in path if x.tag == "main"][-1:]
    out: list[str] = []
    for x in chosen or _dense(path, threshold):
        if isinstance(x, str):
            out.append(x)
        else:
            _collect(x, threshold, out)
            out.append(" " * (x.tag not in INLINE))
    return " ".join(entities.unescape("".join(out)).split())


def _dense(path: list[Node], threshold: float) -> list[Node | str]:
    """In page order the path's first node, and the subtrees and loose texts beside the path that reach the threshold."""
    inside = {id(x) for x in path}
    out: list[Node | str] = []
    todo: list[Node | str] = [path[-1]]
    while todo:
        node = todo.pop()
        if isinstance(node, str) or node is path[0] or id(node) not in inside:
            out.append(node)
        else:
            loose = node.own >= threshold
            todo += [x for x in reversed(node.children) if (loose if isinstance(x, str) else not x.cut and (id(x) in inside or x.chars and x.ctd >= threshold))]
    return out


def extract_html(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row a page: the id, the url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [id, url, "text", "n_chars"])

    types = dict(pages.dtypes)
    return pages.select(f"`{id}`", f"`{url}`", f"`{html}`").mapInArrow(run, f"`{id}` {types[id]}, `{url}` {types[url]}, text string, n_chars long")
