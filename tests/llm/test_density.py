"""Operator 12: main text of pages, on the given pages and on pages of other make."""

import html
import re

from pyspark.sql import functions as F

from pagefold.llm import density, queries

SMALL = "/root/testdata/sf0.001"
LONG = ["The river had risen through the night, and the stone bridge stood a hand above the water when the first carts came.",
        "Nobody in the market spoke of it, though everybody looked up the valley where the clouds were still gathering.",
        "By noon the harbor master had closed the lower gate, and the boats lay two deep along the quay under wet canvas."]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in LONG)


def brute(page):
    """Blocks of the one article of a given page."""
    inner = re.search("<article>(.*?)</article>", page, re.S)[1]
    parts = [re.sub("<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x) for x in re.split("</?(?:p|h1)>", inner)]
    return "\n\n".join(x for x in (re.sub(r"\s+", " ", html.unescape(x)).strip() for x in parts) if x)


def test_op12_given_pages(spark):
    import pyarrow.parquet as pq

    pages = {r["page_id"]: r for r in pq.read_table(f"{SMALL}/pages.parquet").to_pylist()}
    got = queries.op12_html_density(spark, SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], t := brute(pages[r["page_id"]]["html"]), len(t))


def test_unlabelled_boxes_lose_by_density():
    links = "".join(f'<li><a href="/{i}">Section number {i}</a></li>' for i in range(30))
    page = (f"<html><body><div><ul>{links}</ul></div><div><div><h1>Flood</h1>{PARAGRAPHS}</div>"
            f'<div>See also <a href="/x">this other long story about boats</a></div></div><div>Imprint <a href="/i">here</a></div></body></html>')
    assert density.main_text(page).split("\n\n")[:4] == ["Flood", *LONG]
    assert "Section number" not in density.main_text(page) and "Imprint" not in density.main_text(page)


def test_labelled_boxes_go_whatever_their_length():
    much = "<p>" + "I could not agree more with every single word of this. " * 40 + "</p>"
    for box in ('<div class="comments">', '<section id="comment-list">', '<aside>', '<div class="site-footer">', '<div role="banner">',
                '<div class="cookie-notice">', '<form>', '<div class="ad">', '<div id="sideBar">', '<div hidden>', '<header>', '<nav>',
                '<div style="display: none">', '<noscript>', '<template>'):
        tag = re.match(r"<(\w+)", box)[1]
        for page in (f"<body>{box}{much}</{tag}><div class='post'><h1>Flood</h1>{PARAGRAPHS}</div></body>",
                     f"<body><article><h1>Flood</h1>{PARAGRAPHS}{box}{much}</{tag}></article></body>".replace("<header>", "<footer>").replace("</header>", "</footer>")):
            assert density.main_text(page) == "\n\n".join(["Flood", *LONG]), box
    # names that only mention such a box take nothing away
    assert density.main_text(f"<body class='has-sidebar nav-open'><main class='with-comments'>{PARAGRAPHS}</main></body>") == "\n\n".join(LONG)
    assert density.main_text(f"<body><div class='page nav-wrapper'><article>{PARAGRAPHS}</article></div></body>") == "\n\n".join(LONG)


def test_parted_article_keeps_all_parts():
    page = "<body><nav><a href=/>Home</a></nav>" + "".join(f"<section><h2>Part {i}</h2>{PARAGRAPHS}</section>" for i in range(3)) + "</body>"
    assert density.main_text(page) == "\n\n".join(x for i in range(3) for x in [f"Part {i}", *LONG])


def test_awkward_markup():
    assert density.main_text(None) == density.main_text("") == density.main_text("<html><body></body></html>") == ""
    assert density.main_text("no tags at all, 1 < 2 &amp; 3") == "no tags at all, 1 < 2 & 3"
    assert density.main_text("<p>one<p>two <b>bold<p>three</b> x</p><!-- <p>no</p> --><p>a&nbsp;&lt;b\n\n c<br>d</p>") == (
        "one\n\ntwo bold\n\nthree x\n\na <b c d")
    assert density.main_text("<div>first<p>in</p>last</div>") == "first\n\nin\n\nlast"
    assert density.main_text("<p>x <script>var a = '</p><p>no';</script>y</p><style>p{}") == "x y"
    assert density.main_text("<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>") == "one\n\ntwo\n\na\n\nb\n\nc"
    assert density.main_text("<p title=\"a > b\" class='x'>text</p") == "text"
    assert density.main_text("<p>cut <a href=\"x") == "cut" or density.main_text("<p>cut <a href=\"x") == "cut "


def test_long_and_deep_pages_take_linear_time():
    import time

    began = time.process_time()
    assert density.main_text("<div>" * 20_000 + "deep text " + "</div>" * 20_000) == "deep text"
    assert density.main_text("<b><div>" + "<i>" * 20_000 + "x" + "</b>" * 20_000) == "x"
    assert len(density.main_text("<a>word " * 20_000)) == 20_000 * 5 - 1
    assert len(density.main_text("<p>" + "word " * 400_000)) == 400_000 * 5 - 1
    assert density.main_text('<p "' * 20_001) is not None and density.main_text("<" * 50_000 + "a") is not None
    assert time.process_time() - began < 30


def test_op12_awkward_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>text</p>"), (4, "u", "<p>text</p>"), (4, "u", "<p>text</p>"),
            (5, "v", "<p>" + "long " * 100_000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "n_chars", "body")})
    got = density.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(p, u, density.main_text(h), len(density.main_text(h))) for p, u, h in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert density.extract(df.limit(0)).count() == 0
