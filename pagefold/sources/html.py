"""HTML pages -> element table.

One Arrow batch job over the pages table. Every downstream operator (title,
links, media, sections, facts...) is a plain DataFrame operation over the
element table, so a page is parsed exactly once.

Tree rules follow the html.parser tree builder the reference relies on:

* void tags never get children; ``<x/>`` on a non-void tag closes it at once;
* an end tag closes up to the most recent open tag of that name, an end tag
  with no open match is ignored, there are no implied end tags (a new
  ``<p>`` nests in an unclosed one), end of input closes everything;
* attribute names are lower case, entities are decoded, a valueless
  attribute is ``""``, a repeated attribute keeps the last value;
* ``class``/``rel`` are split on whitespace;
* text inside script/style/template/rt/rp, comments and doctype are not
  part of any element's text, CDATA sections are; a whitespace-only text node is collapsed to
  a single newline (if it contains one) or a single space, except inside
  pre/textarea.

Output, one row per element plus one ``[document]`` row (node 0) per page:
``page_id, url, node_id, end_id, parent_id, depth, tag, attrs, classes,
rel, t0, t1, s0, s1, text, text_stripped, parent_head, deferred,
parse_error``. ``node_id`` is the pre-order position and ``end_id`` the
node_id of the last descendant, so "x is inside y" is
``y.node_id < x.node_id <= y.end_id``.

Text is held by interval: the ``[document]`` row has the page's text
(``get_text()``) and its stripped text (``get_text(strip=True)``), every
element the places ``t0..t1`` and ``s0..s1`` of its own in them. Elements
whose text some operator reads (``TEXT_TAGS``, and divs whose classes make
them a section or the main content) also carry it in their row, but only
while fewer than ``INLINE_LEVELS`` elements of their kind are open around
them; deeper ones, as unclosed ``<a>`` tags make them, are ``deferred``
(counted on the document row) and cut from the page's text by
``with_text``. So the table stays linear in the HTML whatever the nesting.
``parent_head`` of an image is the start of its parent's stripped text, as
far as image contexts read it. ``full_text="all"`` carries the text in every
row.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import MAIN_CONTENT_CLASSES, SECTION_CLASS_REGEX

# Tags without children (html.parser tree builder list).
VOID_TAGS = frozenset([
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen",
    "link", "menuitem", "meta", "param", "source", "track", "wbr",
    "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid",
    "spacer",
])
# Tags whose strings are not "text" for get_text().
NON_TEXT_CONTAINERS = frozenset(["script", "style", "template", "rt", "rp"])
PRESERVE_WS_TAGS = frozenset(["pre", "textarea"])
ASCII_SPACES = " \n\t\x0c\r"

DOCUMENT_TAG = "[document]"
PARENT_HEAD_CHARS = 100     # what image contexts (M9) read of the parent's text
# An output batch ends at so many rows, or characters of text.
BATCH_ROWS = 8192
BATCH_CHARS = 4 << 20
# Tags whose subtree text an operator reads (page fields, links, sections,
# About text). Divs are read only when their classes make them a section
# (P12) or the main content.
TEXT_TAGS = frozenset([DOCUMENT_TAG, "title", "a", "h1", "h2", "h3", "h4", "h5", "h6",
                       "article", "main", "section"])
INLINE_LEVELS = 4
_SECTION_DIV = re.compile(SECTION_CLASS_REGEX, re.IGNORECASE)
_CONTENT_DIV = frozenset(MAIN_CONTENT_CLASSES)


def text_kinds(tag: str, class_attr) -> tuple[str, ...]:
    """The kinds of text-bearing element that an element is."""
    if tag in TEXT_TAGS:
        return (tag,)
    if tag == "div" and class_attr:
        classes = class_attr.split()
        section = ("div.section",) if _SECTION_DIV.search(" ".join(classes)) else ()
        return section + (("div.content",) if any(c in _CONTENT_DIV for c in classes) else ())
    return ()


ELEMENT_SCHEMA = pa.schema([
    ("page_id", pa.int64()),
    ("url", pa.string()),
    ("node_id", pa.int32()),
    ("end_id", pa.int32()),
    ("parent_id", pa.int32()),
    ("depth", pa.int32()),
    ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())),
    ("classes", pa.list_(pa.string())),
    ("rel", pa.list_(pa.string())),
    ("t0", pa.int32()),
    ("t1", pa.int32()),
    ("s0", pa.int32()),
    ("s1", pa.int32()),
    ("text", pa.string()),
    ("text_stripped", pa.string()),
    ("parent_head", pa.string()),
    ("deferred", pa.int32()),
    ("parse_error", pa.string()),
])

ELEMENT_DDL = (
    "page_id bigint, url string, node_id int, end_id int, parent_id int, "
    "depth int, tag string, attrs map<string,string>, classes array<string>, rel array<string>, "
    "t0 int, t1 int, s0 int, s1 int, text string, text_stripped string, parent_head string, "
    "deferred int, parse_error string"
)


class _TreeParser(HTMLParser):
    """Builds the flat node list for one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # per node: [tag, attrs, parent, depth, end_id, t0, t1, s0, s1]
        self.nodes: list[list] = [[DOCUMENT_TAG, None, None, 0, 0, 0, 0, 0, 0]]
        self.stack: list[int] = [0]
        self.open_count: dict[str, int] = {}
        self.pending: list[str] = []
        self.text_parts: list[str] = []
        self.text_len = 0
        self.strip_parts: list[str] = []
        self.strip_len = 0
        self.at = 0           # place of the construct at hand in rawdata
        self.hidden = 0       # open non-text containers
        self.preserve = 0     # open pre/textarea

    # -- text -------------------------------------------------------------
    def handle_data(self, data: str) -> None:
        self.pending.append(data)

    def _flush(self) -> None:
        if not self.pending:
            return
        data = "".join(self.pending)
        self.pending = []
        if self.hidden:
            return
        if not self.preserve and data.strip(ASCII_SPACES) == "":
            data = "\n" if "\n" in data else " "
        self.text_parts.append(data)
        self.text_len += len(data)
        stripped = data.strip()
        if stripped:
            self.strip_parts.append(stripped)
            self.strip_len += len(stripped)

    def handle_comment(self, data: str) -> None:
        self._flush()

    def handle_decl(self, decl: str) -> None:
        self._flush()

    def handle_pi(self, data: str) -> None:
        self._flush()

    def unknown_decl(self, data: str) -> None:
        # <![CDATA[...]]> is a text string (CData counts for get_text());
        # other declarations are not text
        self._flush()
        if data.upper().startswith("CDATA["):
            self.pending.append(data[len("CDATA["):])
            self._flush()

    # -- tags -------------------------------------------------------------
    def handle_starttag(self, tag, attrs) -> None:
        self._open(tag, attrs, self_closing=False)

    def handle_startendtag(self, tag, attrs) -> None:
        self._open(tag, attrs, self_closing=True)

    def _open(self, tag: str, attrs, self_closing: bool) -> None:
        self._flush()
        amap: dict[str, str] = {}
        for k, v in attrs:
            amap[k] = "" if v is None else v
        parent = self.stack[-1]
        node_id = len(self.nodes)
        depth = len(self.stack)
        self.nodes.append([tag, amap, parent, depth, node_id,
                           self.text_len, self.text_len,
                           self.strip_len, self.strip_len])
        if tag in VOID_TAGS or self_closing:
            return  # closed at once, no children
        self.stack.append(node_id)
        self.open_count[tag] = self.open_count.get(tag, 0) + 1
        if tag in NON_TEXT_CONTAINERS:
            self.hidden += 1
        if tag in PRESERVE_WS_TAGS:
            self.preserve += 1

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if not self.open_count.get(tag):
            return  # unmatched end tag: ignored
        while len(self.stack) > 1:
            node_id = self.stack.pop()
            self._close(node_id)
            if self.nodes[node_id][0] == tag:
                break

    def _close(self, node_id: int) -> None:
        node = self.nodes[node_id]
        t = node[0]
        node[4] = len(self.nodes) - 1
        node[6] = self.text_len
        node[8] = self.strip_len
        self.open_count[t] -= 1
        if t in NON_TEXT_CONTAINERS:
            self.hidden -= 1
        if t in PRESERVE_WS_TAGS:
            self.preserve -= 1

    def updatepos(self, i: int, j: int) -> int:
        self.at = j
        return super().updatepos(i, j)

    def unread(self) -> str:
        """Takes back what has not been parsed, from the construct at hand."""
        rest, self.rawdata = self.rawdata[self.at:], ""
        return rest

    def parse_html_declaration(self, i: int) -> int:
        """A declaration that the stdlib refuses (``<![foo[x]]>``) is read as
        a bogus comment, as browsers do, and parsing goes on behind it."""
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            return self.parse_bogus_comment(i, 0)

    def finish(self) -> None:
        self.close()
        self.end_page()

    def end_page(self) -> None:
        self._flush()
        while len(self.stack) > 1:
            self._close(self.stack.pop())
        root = self.nodes[0]
        root[4] = len(self.nodes) - 1
        root[6] = self.text_len
        root[8] = self.strip_len


def parse_html(html: str) -> tuple[list[list], str, str, str | None]:
    """Parse one page; returns (nodes, full_text, stripped_text, error).

    If the tokenizer raises on markup that it cannot read, that one "<" is
    taken as text and the rest of the page is parsed; ``error`` names the
    first such fault, so the page can be told from a clean one."""
    p = _TreeParser()
    rest, error = html or "", None
    while True:
        try:
            p.feed(rest)
            p.finish()
            break
        except (AssertionError, ValueError, IndexError) as e:
            error = error or f"{type(e).__name__}: {e}"[:200]
            rest = p.unread()
            if rest:
                p.handle_data(rest[:1])
            else:       # nothing is left to parse: close what is open
                p.end_page()
                break
            rest = rest[1:]
    return p.nodes, "".join(p.text_parts), "".join(p.strip_parts), error


def _split_ws(value):
    if value is None:
        return None
    return value.split()


def inlined(nodes: list[list], all_text: bool = False) -> tuple[list[bool], int]:
    """Which elements carry their text in their row, and how many text-bearing ones don't."""
    out, deferred = [], 0
    open_ends: dict[str, list[int]] = {}
    for i, (tag, amap, _, _, end_id, *_) in enumerate(nodes):
        kinds, shallow = text_kinds(tag, amap.get("class") if amap else None), False
        for kind in kinds:
            ends = open_ends.setdefault(kind, [])
            while ends and ends[-1] < i:
                ends.pop()
            shallow = shallow or len(ends) < INLINE_LEVELS
            ends.append(end_id)
        out.append(all_text or shallow or tag in VOID_TAGS)
        deferred += bool(kinds) and not out[-1]
    return out, deferred


def _batches(it: Iterator[pa.RecordBatch], all_text: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in it:
        ids = batch.column("page_id").to_pylist()
        urls = batch.column("url").to_pylist()
        htmls = batch.column("html").to_pylist()
        cols: dict[str, list] = {f.name: [] for f in ELEMENT_SCHEMA}
        chars = 0
        for pid, url, html in zip(ids, urls, htmls):
            nodes, text, stext, error = parse_html(html)
            inline, deferred = inlined(nodes, all_text)
            for i, (tag, amap, parent, depth, end_id, t0, t1, s0, s1) in enumerate(nodes):
                head = None
                if tag == "img":
                    _, _, _, _, _, _, _, p0, p1 = nodes[parent]
                    head = stext[p0:min(p1, p0 + PARENT_HEAD_CHARS)]
                row = (pid, url, i, end_id, parent, depth, tag,
                       None if amap is None else list(amap.items()),
                       None if amap is None else _split_ws(amap.get("class")),
                       None if amap is None else _split_ws(amap.get("rel")),
                       t0, t1, s0, s1, text[t0:t1] if inline[i] else None, stext[s0:s1] if inline[i] else None,
                       head, None if i else deferred, None if i else error)
                for col, value in zip(cols.values(), row):
                    col.append(value)
                if inline[i]:
                    chars += t1 - t0 + s1 - s0
                if len(cols["page_id"]) >= BATCH_ROWS or chars >= BATCH_CHARS:   # bounded batches, even within one huge page
                    yield pa.RecordBatch.from_pydict(cols, schema=ELEMENT_SCHEMA)
                    cols, chars = {f.name: [] for f in ELEMENT_SCHEMA}, 0
        if cols["page_id"]:
            yield pa.RecordBatch.from_pydict(cols, schema=ELEMENT_SCHEMA)


def with_text(elements: DataFrame, rows: DataFrame, any_element: bool = False) -> DataFrame:
    """``rows`` (a filter of ``elements``) with ``text`` and ``text_stripped`` filled in.

    Rows that carry their text pass as they are. The deferred ones join the
    document rows of just the pages that have any, and cut their interval.
    ``any_element``: ``rows`` also holds elements that are never text-bearing,
    so every page's document row may be needed.
    """
    page = elements.filter(F.col("tag") == DOCUMENT_TAG)
    if not any_element:
        page = page.filter("deferred > 0")
    page = page.select("page_id", F.col("text").alias("_page"), F.col("text_stripped").alias("_page_stripped"))
    cut = rows.filter("text IS NULL").join(page, "page_id").withColumns({
        "text": F.substring("_page", F.col("t0") + 1, F.col("t1") - F.col("t0")),
        "text_stripped": F.substring("_page_stripped", F.col("s0") + 1, F.col("s1") - F.col("s0"))})
    return rows.filter("text IS NOT NULL").unionByName(cut.select(*rows.columns))


def parse_pages(pages: DataFrame, full_text: str = "needed") -> DataFrame:
    """``pages(page_id, url, html)`` -> element table (see module doc).

    Pages are independent, so the parse is a narrow map: no shuffle, each
    task parses the pages of its own input split. Only the three needed
    columns are read from the source, in the splits of its reader
    (``spark.sql.files.maxPartitionBytes``); nothing is shuffled here.
    """
    src = pages.select("page_id", "url", "html")
    all_text = full_text == "all"

    def run(it):
        return _batches(it, all_text)
    return src.mapInArrow(run, ELEMENT_DDL)
