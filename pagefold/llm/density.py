"""Operator 12: main text of web pages by composite text density.

Each page becomes a tree of elements. A node's density is its characters per
tag, scaled by a logarithm that falls with the share of linked characters
and tags; text directly in a node is a child like any other. A node's density
sum adds up its children's densities. The subtree of the largest sum is the
core of the article; the smallest density on the way from it up to the body
is the threshold that other parts, and the parents that the core grows into,
have to reach.

Menus, page headers, footers, sidebars, notices, adverts, forms and comments
that say so by tag, role, class or id, and everything hidden, are taken out
before densities are counted, so they can't win by their length.

A page is one row and is handled within its batch, without a shuffle; a
batch's trees are built one page at a time, in time linear in the page.

Defined cases: a null or empty ``html``, and a page without text, give an
empty text; markup that is cut off or wrongly nested is closed as browsers do
(``p``, ``li``, table parts and the like end where the next one begins), a
page without ``body`` is its own body, ``<`` that begins no tag is text, below
512 open elements new ones are not nested any more, as in browsers (their text
stays). Equal rows give equal rows, further columns of the table are dropped.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

_TOKEN = re.compile(
    r"<!--(?:.*?--!?>|>|.*)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

# Fixed values of HTML: elements without content, of raw content, of inline content, and which end which.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr img".split())
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I) for name in RAW}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
          "tbody": {"table"}, "option": {"select"}}
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: Open elements below which no element is nested, which bounds every walk up the tree.
DEEPEST = 512

#: Elements, roles and words of class names and ids that mark what is not the article.
APART_TAGS = frozenset("nav aside form button select dialog menu svg canvas object audio video template head footer".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promoted menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr newsletter subscribe signup popup modal overlay "
    "comment comments disqus respond reply replies discussion pagination pager login copyright".split())
#: Words that mark it only where the same name has no word of the article itself.
WEAK_WORDS = frozenset("header banner notice notices promo promotion related recommended recommendations share sharing social "
                       "widget legal disclaimer alert toast search toolbar skip topbar outbrain taboola paywall tags".split())
CONTENT_WORDS = frozenset("article post entry content body main story text title headline".split())


def _says_apart(names: str) -> bool:
    """Whether a class or id names something beside the article."""
    for name in names.split():
        words = [w.lower() for w in _NAME_WORDS.findall(name)]
        if words and words[0] in ("has", "with", "no", "without", "is"):
            continue
        words += [a + b for a, b in zip(words, words[1:])]      # sideBar, side-bar
        if any(w in APART_WORDS for w in words):
            return True
        if any(w in WEAK_WORDS for w in words) and not any(w in CONTENT_WORDS for w in words):
            return True
    return False


class Node:
    __slots__ = ("tag", "parent", "children", "apart", "holds", "chars", "tags", "link_chars", "link_tags", "density", "sum", "best")

    def __init__(self, tag: str, parent: Node | None, apart: bool = False):
        self.tag, self.parent, self.apart = tag, parent, apart
        self.children: list[Node | str] = []
        self.holds = False          # an article or main element is inside
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.best: Node | None = None


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        found.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _apart(tag: str, source: str, in_article: bool) -> bool | None:
    """Whether an element stands beside the article: True by tag, role or hiding, None by its names (a guess)."""
    if tag in APART_TAGS or tag == "header" and not in_article:
        return True
    if not source or source.isspace() or tag in ("html", "body", "article", "main"):
        return False
    at = _attributes(source)
    if ("hidden" in at or at.get("aria-hidden") == "true" or at.get("role", "").lower() in APART_ROLES
            or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", at.get("style", ""), re.I)):
        return True
    return None if _says_apart(f"{at.get('class', '')} {at.get('id', '')}") else False


def tree(source: str) -> Node:
    """The element tree of a page; the root stands for the document."""
    root = Node("#document", None)
    at, where, end = root, 0, len(source)
    open_tags: dict[str, int] = {}
    depth = 0

    def close(node: Node) -> Node:
        nonlocal depth
        depth -= 1
        open_tags[node.tag] -= 1
        return node.parent

    def close_to(at: Node, names, barrier) -> Node:
        """Closes the nearest open element of ``names`` if no barrier is open above it."""
        if not any(open_tags.get(n) for n in names):
            return at
        node = at
        while node is not root and node.tag not in names:
            if node.tag in barrier:
                return at
            node = node.parent
        if node is root:
            return at
        while at is not node:
            at = close(at)
        return close(at)

    while where < end:
        opened = source.find("<", where)
        if opened < 0:
            at.children.append(source[where:])
            break
        m = _TOKEN.match(source, opened)
        if m is None:                                   # a "<" that begins no tag is text
            at.children.append(source[where:opened + 1])
            where = opened + 1
            continue
        if opened > where:
            at.children.append(source[where:opened])
        where = m.end()
        if m["cdata"] is not None:
            at.children.append(entities.escape(m["cdata"]))
        elif m["end"] is not None:
            name = m["end"].lower()
            if open_tags.get(name):
                at = close_to(at, (name,), () if name not in INLINE else {"td", "th", "li", "div", "article", "section"})
        elif m["tag"] is not None:
            name = m["tag"].lower()
            if name in ENDS_P:
                at = close_to(at, ("p",), {"td", "th", "div", "li", "article", "section", "button", "blockquote"})
            if name in CLOSED_BY:
                at = close_to(at, CLOSED_BY[name], SCOPES[name])
                if name == "tr":
                    at = close_to(at, ("tr",), {"table"})
            node = Node(name, at, _apart(name, m["attrs"], bool(open_tags.get("article"))))
            if name in ("article", "main"):
                up = at
                while up is not None and not up.holds:
                    up.holds, up = True, up.parent
            at.children.append(node)
            if name in RAW:
                node.apart = True
                ended = _RAW_END[name].search(source, where)
                where = ended.end() if ended else end
            elif name not in VOID and (depth < DEEPEST or node.apart) and not (name in ("svg", "path") and m["attrs"].endswith("/")):
                open_tags[name] = open_tags.get(name, 0) + 1    # a "/" closes no HTML element
                depth += 1
                at = node
    return root


def _in_order(root: Node) -> list[Node]:
    """Nodes that belong to the page's text, parents first; what stands apart is left out."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)
                 and not (c.apart or c.apart is None and not c.holds)]
    return out


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, less the more of them are links; ``share`` is the body's share of linked characters."""
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    return chars / max(tags, 1) * max(math.log(max(chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1), 1)) / math.log(base + 1e-9), 0.0)


def measure(body: Node) -> list[Node]:
    """Counts, densities and density sums of all nodes below ``body``, which come back parents first."""
    nodes = _in_order(body)
    own: dict[int, list[int]] = {}
    linked = {id(n) for n in nodes if n.tag == "a"}
    for n in nodes:
        if n is not body and id(n.parent) in linked:
            linked.add(id(n))
        texts = own[id(n)] = [len(_SPACE.sub(" ", entities.unescape(c)).strip()) for c in n.children if isinstance(c, str)]
        n.chars = sum(texts)
        n.link_chars = n.chars if id(n) in linked else 0
        n.tags, n.link_tags = 0, 0
    for n in reversed(nodes):
        if n is not body:
            up = n.parent
            up.chars += n.chars
            up.link_chars += n.link_chars
            up.tags += n.tags + 1
            up.link_tags += n.link_tags + (n.tag == "a")
    share = body.link_chars / body.chars if body.chars else 0.0
    for n in nodes:
        link = id(n) in linked
        n.density = _density(n.chars, n.tags, n.link_chars, n.link_tags, share)
        n.sum = sum(_density(c, 1, c if link else 0, 1 if link else 0, share) for c in own[id(n)])
        n.best = n
    for n in reversed(nodes):
        if n is not body:
            up = n.parent
            up.sum += n.density
    for n in reversed(nodes):
        if n is not body and n.best.sum > n.parent.best.sum:
            n.parent.best = n.best
    return nodes


def _path(node: Node, top: Node) -> list[Node]:
    out = [node]
    while out[-1] is not top:
        out.append(out[-1].parent)
    return out


def select(body: Node) -> list[Node]:
    """Roots of the main text: the subtree of the largest density sum, grown, and others that reach its threshold."""
    nodes = measure(body)
    core = body.best
    if not core.chars:
        return []
    way = _path(core, body)
    threshold = min(n.density for n in way)
    for up in way[1:-1]:         # grow to parents that add more text than links
        added, links = up.chars - core.chars, up.link_chars - core.link_chars
        if up.density < threshold or 2 * links > added:
            break
        core = up
    inside = {id(n) for n in _path(core, body)}
    found, skipped = [core], set()
    for n in nodes:
        if n is core or n.parent is not None and id(n.parent) in skipped:
            skipped.add(id(n))
        elif id(n) not in inside and n.density >= threshold and n.best.sum >= 0.25 * core.best.sum and 2 * n.link_chars <= n.chars:
            found.append(n.best)
            skipped.add(id(n))
    order = {id(n): i for i, n in enumerate(nodes)}
    return sorted(found, key=lambda n: order[id(n)])


def _menu(node: Node) -> bool:
    """A list of nothing but links."""
    return node.tag in ("ul", "ol", "dl", "table") and node.link_tags > 1 and node.link_chars >= node.chars


def blocks(root: Node) -> Iterator[str]:
    """Text of each block of a subtree, in page order, white space made one space."""
    pieces: list[str] = []
    todo: list[Node | str | None] = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, Node):
            if x is not root and (x.apart or x.apart is None and not x.holds or _menu(x)):
                continue
            if x.tag == "br":
                pieces.append(" ")
            elif x.tag in INLINE:
                todo += reversed(x.children)
            else:
                todo.append(None)
                todo += reversed(x.children)
                todo.append(None)
        elif x is not None:
            pieces.append(x)
        elif pieces:
            text = _SPACE.sub(" ", entities.unescape("".join(pieces))).strip()
            pieces = []
            if text:
                yield text


def main_text(source: str | None) -> str:
    """The article of one page; blocks are parted by an empty line."""
    if not source:
        return ""
    root = tree(source)
    body = next((n for n in _in_order(root) if n.tag == "body"), root)
    return "\n\n".join(t for n in select(body) for t in blocks(n))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of the main text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    src = pages.select("page_id", "url", "html")
    kinds = dict(src.dtypes)
    return src.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
