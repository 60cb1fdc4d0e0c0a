"""Sources/sinks, classic fallbacks, LLM enrichment paths and the smaller
rules (S1, S3, S4, S6, S8, S14, S17, P22, A4, A5, A10, X6, X7, X10, F12,
M14, M20, T7, W9s, L2, L6, L8, H1)."""

import json
import os
import struct
import tempfile
import zlib

import pytest
from pyspark.sql import functions as F

from pagefold.functions.text import supplied_text_override
from pagefold.functions.urls import mime_from_name
from pagefold.operators.cache import CACHE_DDL, get_or_set
from pagefold.operators.json_media import ai_media, first_seen
from pagefold.operators.links import classic_about_page
from pagefold.operators.llm import classic_profile, enrich, failure_profile, meaningful_profile
from pagefold.operators.media import hybrid_media
from pagefold.operators.paging import decode_json_cursor_strict, page_meta_service
from pagefold.operators.thumbs import attach_thumbnails, video_thumbnails
from pagefold.sources.html import parse_pages
from pagefold.sources.pages import image_metadata, read_pages, read_seed_lists, seed_harvest
from pagefold.sources.sinks import result_mode, url_addressed_name, write_json
from pagefold.streaming.operators import throttle_batch


def _png(w, h):
    def chunk(t, d):
        return struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d) & 0xffffffff)
    raw = b"".join(b"\x00" + b"\x80\x40\x20" * w for _ in range(h))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_metadata_scan(spark):
    d = tempfile.mkdtemp(prefix="pf-img-")
    with open(os.path.join(d, "a.png"), "wb") as f:
        f.write(_png(120, 80))
    with open(os.path.join(d, "broken.png"), "wb") as f:
        f.write(b"not an image")
    rows = image_metadata(spark, d).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["width"], r["height"], r["format"], r["mode"]) == (120, 80, "png", "RGB")


def test_read_pages_status_and_seed_lists(spark):
    d = tempfile.mkdtemp(prefix="pf-src-")
    spark.createDataFrame([(1, "u1", "<p>a</p>", 200), (2, "u2", "x", 404)],
                          "page_id long, url string, html string, status int").write.parquet(d + "/p")
    assert [r["page_id"] for r in read_pages(spark, d + "/p", "status").collect()] == [1]
    os.makedirs(d + "/seeds")
    with open(d + "/seeds/a.json", "w") as f:
        json.dump(["https://a.com", "https://b.com"], f, indent=2)
    got = [(r["pos"], r["url"]) for r in read_seed_lists(spark, d + "/seeds").orderBy("pos").collect()]
    assert got == [(0, "https://a.com"), (1, "https://b.com")]


def test_seed_harvest_stops_after_enough_queries(spark):
    rows = [(q, r, f"https://site{q}-{r}.com") for q in range(5) for r in range(3)]
    rows += [(0, 9, "https://www.example.org/x"), (1, 9, "ftp://x.com"), (2, 9, "https://list.com")]
    df = spark.createDataFrame(rows, "query_rank int, result_rank int, href string")
    urls = [r["url"] for r in seed_harvest(df, max_total=5, seed=1).collect()]
    assert len(urls) == 5 and len(set(urls)) == 5
    assert all(u.split("-")[0] in ("https://site0", "https://site1") for u in urls)


def test_url_addressed_name_and_sinks(spark):
    df = spark.createDataFrame([("https://a.com/x", "image/png"), ("https://a.com/y", "text/plain"), ("https://a.com/z", "x/none")],
                               "url string, mime string")
    names = [r[0] for r in df.select(url_addressed_name("url", "mime")).collect()]
    assert names[0].endswith(".png") and names[1].endswith(".txt") and names[2].endswith(".bin") and len(names[0]) == 36
    env = spark.createDataFrame([(1, "p", "m")], "page_id long, profile string, media string")
    assert result_mode(env, "profile", ["profile"], ["media"]).columns == ["page_id", "profile"]
    out = tempfile.mkdtemp(prefix="pf-json-") + "/r"
    write_json(env, out)
    assert spark.read.json(out).count() == 1


def test_supplied_text_override(spark):
    df = spark.createDataFrame([("", "page"), ("mine", "page"), (None, "page")], "s string, e string")
    assert [r[0] for r in df.select(supplied_text_override("s", "e")).collect()] == ["page", "mine", "page"]


def test_classic_about_common_path_and_all_links(spark):
    pages = spark.createDataFrame([
        (1, "https://a.example.com/", "<nav><a href='/x'>Home</a></nav><p>welcome</p>"),
        (2, "https://a.example.com/deep", "<p>nothing here</p>"),
        (3, "https://a.example.com/about-us", "<p>x</p>"),
        (4, "https://b.example.com/", "<p><a href='/who'>About us</a></p>"),
        (5, "https://b.example.com/p", "<p>plain</p>"),
    ], "page_id long, url string, html string")
    el = parse_pages(pages)
    urls = el.filter("tag = '[document]'").select("url")
    got = {r["page_id"]: (r["about_url"], r["found_by"]) for r in classic_about_page(el, urls).collect()}
    assert got[2] == ("https://a.example.com/about-us", "common_path")
    assert got[5] == ("https://b.example.com/p", "fallback")
    app = {r["page_id"]: r["about_url"] for r in
           classic_about_page(el, urls, all_links_fallback=True).collect()}
    assert app[5] == "https://b.example.com/who"


def test_enrich_isolation_fallback_and_profile(spark):
    def model(prompt):
        if "boom" in prompt:
            raise RuntimeError("model down")
        if "bad" in prompt:
            return {"completion": "not json"}
        return {"completion": json.dumps({"content": {"profile": {
            "About Us (including locations)": "We are located in Berlin. Since 1990.", "Our Team": "x"}}})}

    def fallback(prompt):
        return {"completion": json.dumps({"content": {"profile": {"Our Culture": "kind"}}})}

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "boom")], "id long, prompt string")
    first = {r["id"]: r["error"] for r in enrich(df, model).collect()}
    assert first[1] is None and first[2] == "Invalid JSON response" and first[3] == "model down"
    out = enrich(df, model, fallback).select("id", "model", meaningful_profile("result").alias("ok"),
                                             classic_profile("result").alias("p")).collect()
    got = {r["id"]: r for r in out}
    assert got[1]["model"] == "default" and got[2]["model"] == "fallback"
    assert got[1]["p"]["locations"] == "Berlin"
    assert got[1]["p"]["our_culture"] == "Not available"
    assert got[3]["p"]["our_culture"] == "kind" and got[3]["p"]["locations"] == "No location found"
    assert all(r["ok"] for r in out)
    fp = spark.range(1).select(failure_profile(F.lit("e")).alias("f")).first()["f"]
    assert (fp["about_us"], fp["locations"], fp["success"]) == ("Not available", "No location found", False)


def test_json_media_modes(spark):
    doc = {"content": {"logo": "https://x/l.png", "photos": ["https://x/a.jpg", "plain"],
                       "media": {"clip": "https://x/c.mp4"}, "video": "no-ext"}}
    deep = "[" * 400 + '"https://x/deep.png"' + "]" * 400
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, None), (3, "not json"), (4, deep), (5, '["b.PNG", {"image": "x.gif"}]')],
                               "id int, js string")
    found = {mode: [(r["id"], r["media_url"], r["type"], r["context"].removeprefix("AI found: "))
                    for r in ai_media(df, "js", ["id"], mode).orderBy("id", "ord").collect()] for mode in ("api", "app")}
    assert found["api"] == [(1, "https://x/l.png", "image", "logo"), (1, "https://x/c.mp4", "video", "media.clip"),
                            (5, "x.gif", "image", "[1].image")]
    assert found["app"] == [(1, "https://x/l.png", "image", "logo"), (1, "https://x/a.jpg", "image", "photos[0]"),
                            (1, "https://x/c.mp4", "video", "media.clip"), (1, "no-ext", "image", "video"),
                            (4, "https://x/deep.png", "image", "[0]" * 400), (5, "b.PNG", "image", "[0]"),
                            (5, "x.gif", "image", "[1].image")]


def test_html_and_llm_media_are_deduplicated_first_seen(spark):
    html = spark.createDataFrame([(1, "u1", "image", "html", 0, 5, 0), (1, "u2", "video", "html", 1, 2, 0)],
                                 "page_id long, media_url string, type string, context string, pass_no int, node_id int, sub int")
    llm = spark.createDataFrame([(1, "u2", "image", "llm", 0), (1, "u3", "image", "llm", 1), (1, "u3", "video", "again", 2)],
                                "page_id long, media_url string, type string, context string, ord int")
    got = {(r["media_url"], r["type"], r["context"]) for r in first_seen(html, llm).collect()}
    assert got == {("u1", "image", "html"), ("u2", "video", "html"), ("u3", "image", "llm")}


def test_get_or_set_computes_each_missing_key_once(spark):
    cache = spark.createDataFrame([("a", "t", "A", 100, 0), ("old", "t", "O", 5, 0)], CACHE_DDL)
    requests = spark.createDataFrame([("a", "t"), ("b", "t"), ("b", "t"), ("c", "t"), ("old", "t"), ("b", "t")], "url string, type string")
    calls = spark.sparkContext.accumulator(0)

    def getter(misses):
        def run(batches):
            for pdf in batches:
                calls.add(len(pdf))
                yield pdf.assign(data="new " + pdf["url"])
        return misses.mapInPandas(run, "url string, type string, data string")
    answers, table = get_or_set(requests, cache, getter, now=10, ttl=60)
    got = sorted((r["url"], r["data"], r["hit"]) for r in answers.collect())
    assert got == [("a", "A", True), *[("b", "new b", False)] * 3, ("c", "new c", False), ("old", "new old", False)]
    assert {r["url"]: r["data"] for r in table.collect()} == {"a": "A", "b": "new b", "c": "new c", "old": "new old"}
    assert calls.value == 3


def test_mime_tables_are_whole(spark):
    df = spark.createDataFrame([("a.mp3",), ("b.MOV",), ("c.txt",), ("d.bmp",), ("e",), ("f.unknown",)], "n string")
    got = [r[0] for r in df.select(mime_from_name("n")).collect()]
    assert got[0] == "audio/mpeg" and got[1:] == ["video/quicktime", "text/plain", "image/bmp"] + ["application/octet-stream"] * 2


def test_hybrid_image_order_and_v4_thumbnail_attach(spark, parse):
    html = ('<img src="/a.png" alt="x"><img src="/b.png" alt="Our Logo">'
            '<video src="rel.mp4"></video><video src="https://v.example.com/abs.mp4" poster="p.jpg"></video>')
    el = parse(html, "https://s.example.com/")
    imgs = hybrid_media(el).filter("kind = 'images'").orderBy("image_rank", "node_id").collect()
    assert [r["media_url"].rsplit("/", 1)[-1] for r in imgs] == ["b.png", "a.png"]
    vids = spark.createDataFrame([(1, 1, "https://s.example.com/rel.mp4"), (1, 2, "https://v.example.com/abs.mp4")],
                                 "page_id long, ord int, url string")
    got = {r["url"]: r["thumbnail_type"] for r in attach_thumbnails(vids, video_thumbnails(el)).collect()}
    assert got["https://s.example.com/rel.mp4"] is None     # Q5: thumbnails key on the raw src
    assert got["https://v.example.com/abs.mp4"] == "poster"


def test_service_cursor_policy(spark):
    df = spark.createDataFrame([("eyJvZmZzZXQiOiAxMH0=",)], "c string")
    assert df.select(decode_json_cursor_strict("c")).first()[0] == 10
    with pytest.raises(Exception):
        spark.createDataFrame([("invalid-cursor",)], "c string").select(decode_json_cursor_strict("c")).collect()
    meta = spark.range(1).select(*[v.alias(k) for k, v in page_meta_service(F.lit(10), F.lit(9), 3).items()]).first()
    assert meta["has_more"] is False and meta["next_cursor"] is None


def test_throttle_custom_key(spark):
    ev = spark.createDataFrame([(1, "2024-01-01 00:00:00", None, "1.2.3.4"), (2, "2024-01-01 00:00:01", "k1", "1.2.3.4"),
                                (3, "2024-01-01 00:00:02", None, "1.2.3.4")],
                               "event_id long, ts string, api_key string, host string")
    ev = ev.withColumn("ts", F.to_timestamp("ts"))
    out = throttle_batch(ev, F.coalesce("api_key", "host"), rpm=60, burst=1).orderBy("event_id").collect()
    assert [(r["user_id"], r["allowed"]) for r in out] == [("1.2.3.4", True), ("k1", True), ("1.2.3.4", True)]


def test_media_service_limits_and_asset_defaults(spark):
    from pagefold.operators.downloads import media_asset, mime_admitted
    rows = [("https://x/a.jpg", "image/jpeg", 1000, 100, 100, None),
            ("https://x/b.jpg", "image/jpeg", 2 * 1024 * 1024, None, None, None),
            ("https://x/c.txt", "text/plain", 10, None, None, None),
            ("https://x/d.mp4", "video/mp4", 1000, None, None, 600.0)]
    df = spark.createDataFrame(rows, "url string, content_type string, size_bytes long, width int, height int, "
                                     "duration double")
    ok = df.select(mime_admitted("content_type", "size_bytes", max_size=1024 * 1024, duration="duration",
                                 max_video_duration=300).alias("ok")).collect()
    assert [r["ok"] for r in ok] == [True, False, False, False]
    a = media_asset(df.limit(1)).first()
    assert (a["asset_type"], a["asset_width"], a["asset_height"], a["asset_format"], a["asset_priority"]) == \
        ("image", 100, 100, "jpeg", 80)


def test_link_prefilter_does_not_change_container_attribution(spark):
    """Dropping non-candidate links before the running windows leaves the
    kept links' outermost containers unchanged (random nested markup)."""
    import random
    from pagefold.operators.links import links_in_containers
    from pagefold.sources.html import parse_pages
    rnd = random.Random(17)
    pieces = ["<nav>", "</nav>", "<header>", "</header>", "<footer>", "</footer>", "<div>", "</div>",
              "<a href='/about'>About</a>", "<a href='/x'>x</a>", "<a href='/team'>Our team</a>",
              "<a href='/y'>About us</a>", "<a>no href</a>", "<p>", "text"]
    rows = [(i, f"https://s{i}.example.com/", "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 40))))
            for i in range(150)]
    el = parse_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    cont = F.col("tag").isin("nav", "header", "footer")
    cand = lambda href: F.lower(href).rlike("about|team")
    full = links_in_containers(el, cont).filter(cand(F.col("href")))
    pre = links_in_containers(el, cont, cand(F.col("attrs")["href"]))
    key = ["page_id", "node_id", "outer", "href"]
    a = sorted(tuple(r) for r in full.select(*key).collect())
    b = sorted(tuple(r) for r in pre.select(*key).collect())
    assert a == b and len(a) > 50
