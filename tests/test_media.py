"""Media extraction, context, priority and thumbnails."""

from pyspark.sql import functions as F

from pagefold.operators.media import priority_service, split_media, svc_media
from pagefold.operators.thumbs import PLACEHOLDER_URL, thumbnail_struct

SHOP_HTML = """<main>
<h1>Bakery</h1><img alt="Rye loaf" src="bread/rye.webp">
<img title="Oven" src="/oven.png"><p>Morning shift <img src="team.jpg"></p>
<span><img src="plain.gif"></span>
<video title="Kneading" src="knead.mp4"></video><iframe src="tour.webm"></iframe>
</main>"""


def test_svc_media_context_chain(parse):
    m = svc_media(parse(SHOP_HTML, "https://bakery.example/shop/")).collect()
    got = {r["media_url"].removeprefix("https://bakery.example"): (r["type"], r["context"]) for r in m}
    assert got == {
        "/shop/bread/rye.webp": ("image", "Rye loaf"), "/oven.png": ("image", "Oven"),
        "/shop/team.jpg": ("image", "Morning shift"), "/shop/plain.gif": ("image", "Image"),
        "/shop/knead.mp4": ("video", "Kneading"), "/shop/tour.webm": ("video", "Video"),
    }


def test_relative_urls_resolve_against_page(parse):
    html = '<img src="/images/image1.jpg" alt="a"><img src="../images/image2.jpg" alt="b">'
    m = svc_media(parse(html, "https://example.com/page")).collect()
    assert {r["media_url"] for r in m} == {"https://example.com/images/image1.jpg",
                                           "https://example.com/images/image2.jpg"}


def test_missing_src_skipped_data_url_kept_long_parent_truncated(parse):
    long_text = "word " * 60
    html = (f'<img alt="no src"><img src="data:image/png;base64,iVBORw0KGgo=" alt="inline">'
            f'<p><img src="x.png">{long_text}</p><p>&amp; entity <img src="y.png"></p>')
    m = {r["media_url"]: r["context"] for r in svc_media(parse(html, "https://example.com")).collect()}
    assert len(m) == 3
    assert m["data:image/png;base64,iVBORw0KGgo="] == "inline"
    assert len(m["https://example.com/x.png"]) == 100
    assert m["https://example.com/y.png"] == "& entity"


def test_service_priority_table(spark):
    rows = [("Company logo", 200, 200), ("Team photo", 1200, 800), ("Office building", 800, 600),
            ("Product image", 1000, 1000), ("Generic image", 400, 300), ("Company logo", None, None)]
    df = spark.createDataFrame(rows, "context string, width int, height int")
    got = [r[0] for r in df.select(priority_service("context", "width", "height")).collect()]
    assert got == [95, 65, 40, 50, 10, 80]


def test_split_priority_ladder_order(parse):
    html = ('<img src="/a.png" alt="Team founder"><img src="/b.png" class="logo">'
            '<img src="/c.png" alt="brand mark"><img src="/icons/cart.png"><img src="/d.png">'
            '<iframe src="/maps/1"></iframe><iframe src="https://vimeo.com/123"></iframe>'
            '<a href="/doc.PDF">Report</a><a href="/x.docx"></a><link rel="shortcut icon" href="/f.ico">'
            '<link rel="iconic" href="/no.ico">')
    m = {r["media_url"].rsplit("/", 1)[-1]: (r["type"], r["priority"], r["context"])
         for r in split_media(parse(html, "https://s.example.com/")).collect()}
    assert m["a.png"] == ("image", 80, "team founder")
    assert m["b.png"] == ("image", 90, "Image")
    assert m["c.png"] == ("image", 100, "brand mark")
    assert m["cart.png"] == ("image", 10, "Image")
    assert m["d.png"] == ("image", 50, "Image")
    assert "1" not in m                                     # a map iframe is not a video
    assert m["123"] == ("iframe", 60, "Video")
    assert m["doc.PDF"] == ("document", 70, "Report")
    assert m["x.docx"] == ("document", 70, "Document (DOCX)")
    assert m["f.ico"] == ("icon", 85, "Favicon/Icon")
    assert "no.ico" not in m                                # rel tokens match exactly


def test_thumbnail_ladder(spark):
    rows = [("https://cdn.example.com/v.mp4", "/poster.jpg"),
            ("https://www.youtube.com/embed/abcdefghijk", ""),
            ("https://player.vimeo.com/video/76979871", ""),
            ("https://d1.cloudfront.net/protected.mp4", ""),
            ("/local/video.mp4", None)]
    df = spark.createDataFrame(rows, "url string, poster string")
    t = df.select(thumbnail_struct("url", "poster", F.lit("https://example.com")).alias("t")).collect()
    t = [r["t"] for r in t]
    assert (t[0]["thumbnail_url"], t[0]["thumbnail_type"], t[0]["source"]) == \
        ("https://example.com/poster.jpg", "poster", "existing_poster")
    assert t[1]["thumbnail_url"] == "https://img.youtube.com/vi/abcdefghijk/maxresdefault.jpg"
    assert (t[2]["thumbnail_url"], t[2]["source"]) == ("https://vumbnail.com/76979871.jpg", "vimeo")
    for r in t[3:]:
        assert (r["thumbnail_url"], r["thumbnail_type"], r["is_placeholder"]) == (PLACEHOLDER_URL, "placeholder", True)
    assert t[0]["width"] == 320 and t[0]["height"] == 180


def test_hybrid_counts_equal_full_media_summary(spark):
    from pagefold.operators.media import hybrid_counts, hybrid_media, hybrid_summary
    from pagefold.sources.html import parse_pages
    from pagefold.sources.standin import company_site, gallery_pages
    sf = "/root/testdata/sf0.001"
    for pages in (gallery_pages(spark, sf), company_site(spark, sf)):
        el = parse_pages(pages)
        a = sorted(map(tuple, hybrid_counts(el).collect()))
        b = sorted(map(tuple, hybrid_summary(hybrid_media(el)).collect()))
        assert a == b and len(a) > 0


def test_document_prefilter_keeps_every_possible_document(parse):
    html = ('<a href="/r.pdf">a</a><a href="?page=2">b</a><a href="#top">c</a><a href="x/../y.doc">d</a>'
            '<a href="/page.html">e</a><a href="mailto:a@b.com">f</a><a href="">g</a>')
    got = {r["media_url"] for r in split_media(parse(html, "https://s.example.com/docs/base.pdf")).collect()}
    assert got == {"https://s.example.com/r.pdf", "https://s.example.com/docs/base.pdf?page=2",
                   "https://s.example.com/docs/base.pdf#top", "https://s.example.com/docs/y.doc"}


def test_classic_media_passes_and_backgrounds(parse):
    from pagefold.operators.media import classic_media
    html = ('<div style="background-image: url(\'/a.png\'); background-image: url(&quot;/b.jpg&quot;)">'
            '<img src="/img/team-photo.jpg"><img src="/icons/menu.svg" alt="x"><img data-src="/p.jpg" alt="Shop">'
            '<video src="/v.mp4"><source src="/v.webm"></video></div>')
    rows = sorted(classic_media(parse(html)).collect(), key=lambda r: (r["pass_no"], r["node_id"], r["sub"]))
    assert [(r["media_url"], r["type"], r["context"]) for r in rows] == [
        ("/img/team-photo.jpg", "image", "Company image: Branding content"),
        ("/p.jpg", "image", "Content image: shop"),
        ("/v.mp4", "video", "Video content"),
        ("/v.webm", "video", "Video content"),
        ("/a.png", "image", "Background image"),
        ("/b.jpg", "image", "Background image"),
    ]


def test_media_types_by_tag_equal_the_full_split_list(spark):
    """Q-B totals type img/video/link rows by tag and resolve only iframe and
    anchor URLs; the (page, type) multiset must equal split_media's."""
    import random
    from pyspark.sql import functions as F
    from pagefold.operators.media import split_media, split_media_types
    from pagefold.sources.html import parse_pages
    rnd = random.Random(23)
    pieces = ["<img src='a.png'>", "<img src=''>", "<img data-src='/l.jpg'>", "<img>", "<img data-lazy-src='z.gif'>",
              "<video src='v.mp4'></video>", "<video></video>", "<video data-src='/v'></video>",
              "<iframe src='https://www.youtube.com/embed/x'></iframe>", "<iframe src='/frame'></iframe>",
              "<iframe></iframe>", "<link rel='icon' href='/f.ico'>", "<link rel='icon'>",
              "<link rel='stylesheet' href='s.css'>", "<link rel='shortcut icon' href=''>",
              "<a href='/doc.pdf'>Doc</a>", "<a href='/page'>p</a>", "<a href='x.docx'></a>", "<a>n</a>",
              "<div>", "</div>"]
    rows = [(i, f"https://video{i % 3}.example.com/dir/", "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 30))))
            for i in range(120)]
    el = parse_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    a = sorted(tuple(r) for r in split_media(el).groupBy("page_id", "type").count().collect())
    b = sorted(tuple(r) for r in split_media_types(el).groupBy("page_id", "type").count().collect())
    assert a == b and len({t for _, t, _ in a}) >= 4


def test_simple_media_matches_brute_force(spark):
    """M8: first 20 images and first 10 videos per page in document order,
    checked against a brute-force cut of the full split list."""
    import random
    from collections import defaultdict
    from pagefold.operators.media import simple_media, split_media
    from pagefold.sources.html import parse_pages
    rnd = random.Random(9)
    pieces = ["<img src='a%d.png'>", "<img src=''>", "<img data-src='/l%d.jpg'>", "<img>",
              "<video src='v%d.mp4'></video>", "<iframe src='https://www.youtube.com/embed/%d'></iframe>",
              "<iframe src='/frame%d'></iframe>", "<div>", "</div>"]

    def piece(j):
        p = rnd.choice(pieces)
        return p % j if "%d" in p else p
    rows = [(i, f"https://video{i % 2}.example.com/d/", "".join(piece(j) for j in range(rnd.randint(0, 80))))
            for i in range(80)]
    el = parse_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    full = defaultdict(list)
    for r in split_media(el).select("page_id", "node_id", "type", "media_url").collect():
        kind = "images" if r["type"] == "image" else "videos" if r["type"] in ("video", "iframe") else None
        if kind:
            full[(r["page_id"], kind)].append((r["node_id"], r["media_url"]))
    want = sorted((pid, kind, i + 1, u) for (pid, kind), xs in full.items()
                  for i, (_, u) in enumerate(sorted(xs)[:20 if kind == "images" else 10]))
    got = sorted(tuple(r) for r in simple_media(el).collect())
    assert got == want and any(k == "images" and o == 20 for _, k, o, _ in got)
