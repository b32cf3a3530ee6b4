"""Main text of raw HTML by tree scoring.

A tolerant parse builds a tree of elements.  Each paragraph gives points (one, one for each comma, one for each hundred
characters up to three) to its parent in full, to its grandparent by half and to the next ancestors by a third and so on;
a container's points are discounted by its link density.  The best container, and siblings that look like part of it,
give the text.  Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left
out by element, by role and by class or id words before scoring.

Defined results: null or empty html gives an empty text; a page without paragraphs gives the text of its article, main or
body element less the parts left out; malformed markup never fails (unclosed elements end where their parent ends, a stray
``<`` is text); repeated rows are judged each; other columns stay, and a column of a result's name is replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbytes as tb

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
OUT = frozenset(
    "head script style noscript template iframe object embed svg canvas nav header footer aside form button select textarea input label fieldset dialog menu audio video title".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul br".split()
)
PARAGRAPH = frozenset("p pre td blockquote dd li".split())
CONTAINER = frozenset("article main body div section td blockquote center".split())
#: Opening one of the first ends an open element of the second kind, up to the limit of the third.
_ENDS_P = BLOCK - {"br", "body", "html", "option", "optgroup", "legend"}
_SIBLINGS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
_SCOPE = frozenset("table td th button body html".split())
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|"
    r"side-?bar|aside|rail|widget|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|toolbar|masthead|site-?header|page-?header|header|foot|footer|site-?footer|"
    r"comments?|commentlist|comment-?form|respond|replies|disqus|reviews?|share|sharing|social|related|recommend\w*|outbrain|taboola|skip|hidden|disclaimer|copyright|legal)(?:$|[\s_-])"
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>",
    re.S,
)
#: One attribute at a time, value included, so that no word inside a value is taken for a name.
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")
_NAMES = frozenset(("class", "id", "role", "hidden", "style", "aria-hidden"))
#: A page or container *with* a sidebar is not one.
_WITH = re.compile(r"(?:^|(?<=[\s_-]))(?:with|has|no|without)[_-][^\s]*")
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("kids", "out", "parent", "score", "tag")

    def __init__(self, tag: str, parent: Node | None, out: bool = False):
        self.tag, self.parent, self.kids, self.out, self.score = tag, parent, [], out, 0.0


def _left_out(tag: str, attributes: str) -> bool:
    if tag in OUT:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in _ATTR.finditer(attributes):
        name, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if name not in _NAMES:
            continue
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NONE.search(value):
            return True
        if name == "role" and value.lower() in _ROLES or name in ("class", "id") and _BAD.search(_WITH.sub("", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower())):
            return True
    return False


def parse(page: str) -> Node:
    """The tree of ``page``: children are nodes or decoded strings."""
    root = here = Node("#root", None)
    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            break
        if m.start() > at:
            here.kids.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                here.kids.append(m[0][9:-3])
            continue
        tag = name.lower()
        if m[1] or m[4]:
            up = here
            while up is not None and up.tag != tag:
                up = None if up.tag in _SCOPE and tag not in _SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "article", "main", "section", "div", "form", "ul", "ol") else up.parent
            if up is not None and up.parent is not None:
                here = up.parent
            continue
        if tag in _ENDS_P:
            up = here
            while up.tag != "#root" and up.tag not in _SCOPE and up.tag != "p" and (up.tag not in BLOCK):
                up = up.parent
            if up.tag == "p":
                here = up.parent
        if tag in _SIBLINGS:
            ends, stop = _SIBLINGS[tag]
            up, last = here, None
            while up.tag != "#root" and up.tag not in stop:
                if up.tag in ends:
                    last = up
                up = up.parent
            if last is not None:
                here = last.parent
        node = Node(tag, here, _left_out(tag, m[3] or m[6] or ""))
        here.kids.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>]|\\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not (m[3] or m[6] or "").endswith("/"):
            here = node
    if at < len(page):
        here.kids.append(html.unescape(page[at:]))
    return root


def _gather(root: Node) -> list[tuple[Node, bool]]:
    """All nodes that are not left out, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.out:
            continue
        out.append(node)
        stack += [k for k in reversed(node.kids) if type(k) is Node]
    return out


def text_of(tops: list[Node], dense: dict[int, float] | None = None) -> str:
    """The text below ``tops`` in page order: blocks joined by one space, white space inside them made one space."""
    parts: list[str] = []
    for top in tops:
        parts.append(" ")
        stack: list = [top]
        while stack:
            x = stack.pop()
            if type(x) is str:
                parts.append(x)
            elif not x.out and (x is top or not dense or dense.get(id(x), 0.0) <= 0.6):
                if x.tag in BLOCK:
                    parts.append(" ")
                    stack.append(" ")
                stack.extend(reversed(x.kids))
    return " ".join("".join(parts).split())


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    nodes = _gather(root)
    size, links, commas = {}, {}, {}
    for node in reversed(nodes):
        n = l = c = 0
        for k in node.kids:
            if type(k) is str:
                n += len(k) - k.count(" ") // 2 if not k.isspace() else 0
                c += k.count(",") + k.count("，") + k.count("、")
            elif not k.out:
                n, l, c = n + size[id(k)], l + links[id(k)], c + commas[id(k)]
        size[id(node)], links[id(node)], commas[id(node)] = n, n if node.tag == "a" else l, c
    density = lambda x: links[id(x)] / max(1, size[id(x)])
    best, top = None, 0.0
    scored: list[Node] = []
    for node in nodes:
        bare = node.tag in CONTAINER and sum(len(k.strip()) for k in node.kids if type(k) is str) >= 25
        if node.tag not in PARAGRAPH and not bare or not size[id(node)]:
            continue
        if node.tag == "li" and density(node) > 0.5:
            continue
        points = 1 + commas[id(node)] + min(size[id(node)] / 100, 3)
        up, share = (node if bare and node.tag not in PARAGRAPH else node.parent), 1
        while up is not None and share <= 4:
            if up.tag in CONTAINER or up.tag == "#root":
                if not up.score:
                    scored.append(up)
                up.score += points / share
                share += 1
            up = up.parent
    for node in scored:
        final = node.score * (1 - density(node)) * (1.25 if node.tag in ("article", "main") else 1.0)
        node.score = final
        if final > top:
            best, top = node, final
    if best is None:
        best = next((n for n in nodes if n.tag == "article"), None) or next((n for n in nodes if n.tag == "main"), None) or next((n for n in nodes if n.tag == "body"), root)
    tops = [best]
    if best.parent is not None:
        tops = []
        for kid in best.parent.kids:
            if kid is best:
                tops.append(kid)
            elif type(kid) is Node and not kid.out:
                n = size.get(id(kid), 0)
                paragraph = kid.tag in PARAGRAPH and n > 80 and density(kid) < 0.25
                if n and (kid.tag == best.tag and kid.score >= max(10.0, 0.2 * top) or paragraph or kid.tag in ("h1", "h2") and density(kid) < 0.25 and best.tag != "body"):
                    tops.append(kid)
    dense = {id(n): density(n) for n in nodes if n.tag in ("ul", "ol", "div", "section", "table", "dl") and size[id(n)]}
    return text_of(tops, dense)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` without the html column, with ``text`` and ``n_chars``."""
    names = [c for c in pages.columns if c not in ("text", "n_chars", column)]
    schema = pages.select(*names).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, j - i) for b in batches for i, j in tb.chunks(tb.text_bytes(b.column(len(names)))[1])):
            texts = [main_text(x.as_py()) for x in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*names, "text", "n_chars"])

    return pages.select(*names, column).mapInArrow(run, schema)
