"""The HTML -> element table parser (tree rules, text, attributes)."""

from pagefold.sources.html import DOCUMENT_TAG, parse_html


def nodes_by_tag(html):
    nodes, text, stext, _ = parse_html(html)
    return nodes, text, stext


def test_preorder_ids_and_subtree_interval():
    nodes, *_ = parse_html("<div><p>a</p><p>b<b>c</b></p></div><span>d</span>")
    tags = [n[0] for n in nodes]
    assert tags == [DOCUMENT_TAG, "div", "p", "p", "b", "span"]
    div = nodes[1]
    assert div[4] == 4          # end_id = last descendant (the <b>)
    assert nodes[5][2] == 0     # span's parent is the document
    assert nodes[4][2] == 3 and nodes[4][3] == 3   # b under second p, depth 3


def test_unclosed_p_nests_and_unmatched_end_ignored():
    nodes, *_ = parse_html("<body><p>one<p>two</span></body>")
    p1, p2 = [i for i, n in enumerate(nodes) if n[0] == "p"]
    assert nodes[p2][2] == p1   # no implied </p>: the second p nests in the first


def test_void_and_self_closing_tags_have_no_children():
    nodes, *_ = parse_html("<div><img src=a.png><br/><div/>x</div>")
    tags = [n[0] for n in nodes]
    assert tags == [DOCUMENT_TAG, "div", "img", "br", "div"]
    assert all(n[2] == 1 for n in nodes[2:])   # all children of the outer div


def test_text_excludes_script_style_comments_and_decodes_entities():
    html = ("<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style>"
            "<script>var t='</p>';</script></head><body><!-- c --><p>x &lt; y</p></body></html>")
    nodes, text, *_ = parse_html(html)
    assert text == "A & Bx < y"
    title = [n for n in nodes if n[0] == "title"][0]
    assert text[title[5]:title[6]] == "A & B"


def test_whitespace_only_strings_collapse_and_strip_text():
    nodes, text, stext, _ = parse_html("<div>\n   \n<p> a </p>  <p>b</p></div>")
    assert text == "\n a  b"
    assert stext == "ab"


def test_attributes_lowercase_valueless_and_last_duplicate_wins():
    nodes, *_ = parse_html('<A HREF="/x" Data-X data-x="2" hidden class="a  b">t</A>')
    tag, attrs = nodes[1][0], nodes[1][1]
    assert tag == "a"
    assert attrs == {"href": "/x", "data-x": "2", "hidden": "", "class": "a  b"}


def test_spark_element_table(spark, parse):
    el = parse('<html lang="en"><body><nav><a href="/about" rel="nofollow me">About</a></nav></body></html>')
    rows = {r["tag"]: r for r in el.collect()}
    assert rows["a"]["rel"] == ["nofollow", "me"]
    assert rows["a"]["text"] == "About"
    assert rows["nav"]["end_id"] == rows["a"]["node_id"]
    assert (rows["body"]["s0"], rows["body"]["s1"]) == (0, 5) and rows[DOCUMENT_TAG]["deferred"] == 0
    assert rows["nav"]["text"] is None
    assert rows[DOCUMENT_TAG]["parent_id"] is None


def test_full_text_only_where_read(parse):
    el = parse('<div class="wrap"><div class="about-section">Hi <b>there</b></div><div id="x">plain</div></div>')
    rows = {(r["tag"], r["attrs"].get("class") if r["attrs"] else None): r for r in el.collect()}
    assert rows[("div", "about-section")]["text_stripped"] == "Hithere"
    assert rows[("div", "wrap")]["text"] is None
    page = rows[(DOCUMENT_TAG, None)]["text_stripped"]
    assert page[rows[("div", "wrap")]["s0"]:rows[("div", "wrap")]["s1"]] == "Hithereplain"
    assert rows[("div", None)]["text"] is None


def test_cdata_is_text_and_declarations_are_not():
    _, text, *_ = parse_html("<p>a<![CDATA[ b ]]>c<!ELEMENT x>d</p>")
    assert text == "a b cd"


def test_random_tag_soup_keeps_tree_invariants():
    import random
    rnd = random.Random(5)
    pieces = ["<div>", "</div>", "<p>", "</p>", "<a href='/x'>", "</a>", "<br>", "<img src=x.png>", "<b>",
              "</span>", "text", "  ", "\n", "&amp;", "&lt;", "<!-- c -->", "<script>var a='<p>';</script>",
              "<![CDATA[x]]>", "<section class=about>", "</section>", "<li>", "<ul>", "</ul>", "<x/>", "<h1>"]
    for _ in range(200):
        html = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 40)))
        nodes, text, stext, _ = parse_html(html)
        assert nodes[0][0] == DOCUMENT_TAG and nodes[0][4] == len(nodes) - 1
        for i, (tag, attrs, parent, depth, end_id, t0, t1, s0, s1) in enumerate(nodes[1:], start=1):
            assert end_id >= i
            p = nodes[parent]
            assert parent < i <= p[4] and end_id <= p[4]       # child interval inside parent's
            assert depth == p[3] + 1
            assert p[5] <= t0 <= t1 <= p[6] and p[7] <= s0 <= s1 <= p[8]
        assert text[nodes[0][5]:nodes[0][6]] == text


def test_huge_page_is_emitted_in_bounded_batches():
    import pyarrow as pa
    from pagefold.sources.html import BATCH_ROWS, _batches
    html = "<ul>" + "<li>x</li>" * 20000 + "</ul>"
    batch = pa.RecordBatch.from_pydict({"page_id": [1], "url": ["u"], "html": [html]})
    sizes = [b.num_rows for b in _batches(iter([batch]))]
    assert sum(sizes) == 20002 and max(sizes) <= BATCH_ROWS


def test_refused_declaration_loses_nothing():
    nodes, text, _, error = parse_html("<p>a</p><![foo[x]]><p>kept</p><![if !IE]>b<![endif]><i>c</i>")
    assert text.startswith("a") and "kept" in text and "b" in text and text.endswith("c") and error is None
    assert [n[0] for n in nodes].count("p") == 2


def test_a_fault_of_the_tokenizer_is_recorded_and_skipped(monkeypatch):
    from pagefold.sources import html as H
    real = H._TreeParser.parse_starttag

    def broken(self, i):
        if self.rawdata.startswith("<bad", i):
            raise ValueError("no such markup")
        return real(self, i)
    monkeypatch.setattr(H._TreeParser, "parse_starttag", broken)
    nodes, text, _, error = parse_html("<p>one</p><bad x>two<b>three</b>")
    assert error == "ValueError: no such markup" and "two" in text and "three" in text
    assert [n[0] for n in nodes][1:] == ["p", "b"]


def test_page_row_carries_the_error(parse):
    row = parse("<p>x</p>").filter("tag = '[document]'").first()
    assert row["parse_error"] is None


def test_unclosed_tags_give_a_table_linear_in_the_page():
    import pyarrow as pa
    from pagefold.sources.html import _batches

    def size(n):
        html = "".join(f"<a href=/{i}>link {i} <h2>head <section><div class='about content'>" for i in range(n))
        batch = pa.RecordBatch.from_pydict({"page_id": [1], "url": ["u"], "html": [html]})
        return sum(b.nbytes for b in _batches(iter([batch]))) / len(html)
    assert size(4000) < 1.3 * size(400)


def test_batches_are_bounded_by_their_text():
    import pyarrow as pa
    from pagefold.sources.html import BATCH_CHARS, _batches
    html = "<article>" + "<h2>" + "long " * 20_000 + "</h2>"
    pages = pa.RecordBatch.from_pydict({"page_id": list(range(60)), "url": ["u"] * 60, "html": [html] * 60})
    found = [sum(len(t or "") for c in ("text", "text_stripped") for t in b.column(c).to_pylist()) for b in _batches(iter([pages]))]
    assert sum(found) == 60 * 3 * (100_000 + 99_999) and max(found) < BATCH_CHARS + 3 * 200_000


def test_deferred_texts_are_cut_from_the_page(spark):
    import random
    from pagefold.sources.html import parse_pages, with_text
    rnd = random.Random(9)
    pieces = ["<a href=/x>", "<a href=/y>", "</a>", "<h2>", "</h2>", "<section>", "<div class=about>", "<div class='content team'>",
              "<div class=plain>", "</div>", "text \U0001F469 ", " \n ", "é&amp;", "<br>", "<img src=i>", "<script>no</script>"]
    pages = [(i, "u", "".join(rnd.choice(pieces) for _ in range(120))) for i in range(30)] + [(99, "u", None)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    el, whole = parse_pages(df), parse_pages(df, full_text="all")
    assert el.filter("deferred > 0").count() > 10
    for rows, any_element in ((lambda e: e.filter("tag IN ('a', 'h2', 'section', '[document]')"), False), (lambda e: e, True)):
        def texts(frame):
            return sorted(map(tuple, frame.select("page_id", "node_id", "text", "text_stripped").collect()))
        assert texts(with_text(el, rows(el), any_element)) == texts(rows(whole))


def test_operators_read_deferred_texts(spark):
    """A page of unclosed tags gives the links and sections that its whole texts give."""
    from pagefold.operators.links import hybrid_about_links, split_about_links
    from pagefold.operators.media import hybrid_media, split_media
    from pagefold.operators.page import link_list
    from pagefold.operators.sections import sections
    from pagefold.sources.html import parse_pages
    html = "<nav>" + "".join(f"<a href='/p{i}.pdf'>our team {i}<a href='/about{i}'><section class=about>part {i} " for i in range(12))
    df = spark.createDataFrame([(1, "https://x.org/", html), (2, "https://y.org/", "<nav><a href='/about'>About</a></nav>")],
                               "page_id bigint, url string, html string")
    el, whole = parse_pages(df), parse_pages(df, full_text="all")
    for f in (hybrid_about_links, split_about_links, hybrid_media, split_media, link_list, sections):
        got, want = f(el), f(whole)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 9


def test_company_site_is_parsed_by_as_many_tasks_as_its_suppliers_ask_for(spark, tmp_path):
    from pagefold.sources.standin import SUPPLIERS_A_TASK, company_site

    n = 3 * SUPPLIERS_A_TASK
    spark.range(n).selectExpr("id s_suppkey", "'n' s_name", "0 s_nationkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, "FRANCE")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    from pyspark.sql import functions as F

    site = company_site(spark, str(tmp_path))
    tasks = site.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == n + n - n // 3 and max(r["count"] for r in tasks) <= SUPPLIERS_A_TASK + 10
