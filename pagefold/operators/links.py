"""About-page discovery.

Containment ("link inside nav/header/footer") uses the pre-order numbering:
a container is top-level iff no earlier container is still open, and a
link's outermost container is the last top-level container whose interval
covers it. Two running windows over the (few) container and link rows of
each page answer that without pairing every container with every link.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import (
    ABOUT_CONTENT_PHRASES, ABOUT_LINK_KEYWORDS, ABOUT_LINK_PHRASES, ABOUT_TEXT_KEYWORDS_HYBRID,
    ABOUT_TEXT_KEYWORDS_SPLIT, ABOUT_URL_PATTERNS, COMMON_PATHS, HIGH_CONFIDENCE_TEXT, alternation,
)
from ..functions.text import clean_whitespace, py_strip
from ..functions.urls import resolve_url, url_netloc, url_scheme
from ..sources.html import with_text
from .topk import first_k

_PAT = "|".join(ABOUT_URL_PATTERNS)  # regexes, searched


def links_in_containers(elements: DataFrame, container: Column, link_filter: Column | None = None) -> DataFrame:
    """``a[href]`` rows that sit inside an element matching ``container``,
    with ``outer`` = node_id of the outermost such container (the
    reference visits containers in document order, so a link is first seen
    under its outermost container). ``link_filter`` (over element columns)
    drops links before the running windows: the windows' values come from
    container rows only, so the result for the kept links is unchanged and
    the windows see just the containers and the candidate links."""
    is_link = (F.col("tag") == "a") & F.col("attrs")["href"].isNotNull()
    if link_filter is not None:
        is_link = is_link & F.coalesce(link_filter, F.lit(False))
    # the filter on links may read their text, so deferred texts are filled in
    # before it; containers stand for themselves
    anchors = with_text(elements, elements.filter((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull()))
    rows = anchors.filter(is_link | container).unionByName(elements.filter(~((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull())
                                                                           & container)).select(
        "page_id", "url", "node_id", "end_id", "tag", "attrs", "text",
        container.alias("is_c"), is_link.alias("is_a"))
    w = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_open", F.max(F.when(F.col("is_c"), F.col("end_id"))).over(w))
    rows = rows.withColumn("_top", F.col("is_c") & (F.coalesce("_open", F.lit(-1)) < F.col("node_id")))
    rows = rows.withColumn("_last", F.last(F.when(F.col("_top"), F.struct("node_id", "end_id")),
                                           ignorenulls=True).over(w))
    inside = F.col("is_a") & (F.col("_last.end_id") >= F.col("node_id"))
    return rows.filter(inside).select("page_id", "url", "node_id", F.col("_last.node_id").alias("outer"),
                                      F.col("attrs")["href"].alias("href"), "text")


def hybrid_about_links(elements: DataFrame) -> DataFrame:
    """A1: about links in nav/header/footer; match on URL pattern or text
    keyword; confidence high iff text has about/company; distinct url keeping
    the first seen; ``sort_key`` = (confidence rank, first position)."""
    cont = F.col("tag").isin("nav", "header", "footer")
    text_l = F.lower(py_strip("text"))

    def match(href):
        return F.lower(href).rlike(_PAT) | text_l.rlike(alternation(ABOUT_TEXT_KEYWORDS_HYBRID))
    ls = links_in_containers(elements, cont, match(F.col("attrs")["href"]))
    ls = ls.filter(match(F.col("href"))).select(
        "page_id", "url", "outer", "node_id", resolve_url("url", "href").alias("about_url"),
        py_strip("text").alias("text"),
        F.when(text_l.rlike(alternation(HIGH_CONFIDENCE_TEXT)), "high").otherwise("medium").alias("confidence"))
    first = ls.groupBy("page_id", "about_url").agg(
        F.min_by(F.struct("text", "confidence"), F.struct("outer", "node_id")).alias("v"),
        F.min(F.struct("outer", "node_id")).alias("pos"))
    return first.select("page_id", "about_url", F.col("v.text").alias("text"),
                        F.col("v.confidence").alias("confidence"),
                        F.struct(F.when(F.col("v.confidence") == "high", 0).otherwise(1).alias("c"),
                                 F.col("pos")).alias("sort_key"))


def split_about_links(elements: DataFrame) -> DataFrame:
    """A2: every ``a[href]``; text keyword -> 0.9 (title = text); URL pattern
    (case-insensitive) -> 0.8 (title = text or "About Page"). Per url: the
    max score, the title of the first entry with that score, and the url's
    first position as tie-break (Python dict order + stable sort)."""
    a = elements.filter((F.col("tag") == "a") & (F.coalesce(F.col("attrs")["href"], F.lit("")) != ""))
    a = with_text(elements, a).select("page_id", "url", "node_id", F.col("attrs")["href"].alias("href"),
                 py_strip("text").alias("title"))
    by_text = F.lower("title").rlike(alternation(ABOUT_TEXT_KEYWORDS_SPLIT))
    by_url = F.col("href").rlike("(?i)" + _PAT)
    # neither test reads the resolved URL: resolve only the matching anchors
    a = a.filter(by_text | by_url).withColumn("about_url", resolve_url("url", "href"))
    entries = F.filter(F.array(
        F.when(by_text, F.struct(F.lit(0.9).alias("score"), F.lit(0).alias("sub"), F.col("title").alias("title"))),
        F.when(by_url, F.struct(F.lit(0.8).alias("score"), F.lit(1).alias("sub"),
                                F.when(F.col("title") != "", F.col("title")).otherwise("About Page").alias("title")))),
        lambda e: e.isNotNull())
    e = a.select("page_id", "about_url", "node_id", F.explode(entries).alias("e"))
    e = e.select("page_id", "about_url", F.struct("node_id", F.col("e.sub").alias("sub")).alias("pos"),
                 F.col("e.score").alias("score"), F.col("e.title").alias("title"))
    g = e.groupBy("page_id", "about_url").agg(
        F.max("score").alias("relevance_score"),
        F.max_by("title", F.struct("score", F.struct(-F.col("pos.node_id"), -F.col("pos.sub")))).alias("title"),
        F.min("pos").alias("first_pos"))
    return g.withColumn("sort_key", F.struct(-F.col("relevance_score"), F.col("first_pos")))


def top_about(links: DataFrame, n: int) -> DataFrame:
    """The first ``n`` about links per page by ``sort_key`` (``rank``)."""
    return first_k(links, ["page_id"], ["sort_key"], n, "rank")


def page_texts(elements: DataFrame) -> DataFrame:
    """url -> (page_id, title, cleaned text) for every crawled page (J2's
    right side)."""
    f = elements.filter(F.col("tag").isin("title", "[document]")).groupBy("page_id").agg(
        F.any_value("url").alias("url"),
        F.expr("min_by(text, node_id) FILTER (WHERE tag = 'title')").alias("title"),
        F.expr("min_by(text, node_id) FILTER (WHERE tag = '[document]')").alias("doc_text"))
    return f.select(F.col("url").alias("about_url"), F.col("page_id").alias("about_page_id"),
                    F.coalesce(py_strip("title"), F.lit("")).alias("about_title"),
                    clean_whitespace("doc_text").alias("about_text"))


def about_content_page(elements: DataFrame) -> DataFrame:
    """pages whose lower-cased text contains an about phrase."""
    doc = elements.filter(F.col("tag") == "[document]")
    return doc.select("page_id", "url", F.lower("text").rlike(alternation(ABOUT_CONTENT_PHRASES))
                      .alias("has_about_content"))


def classic_about_page(elements: DataFrame, corpus_urls: DataFrame,
                       paths: Sequence[str] = COMMON_PATHS, all_links_fallback: bool = False) -> DataFrame:
    """The classic fallback ladder per page. The page itself
    if it has about content (F6); else, on the site's root page
    (scheme://netloc), the first nav/header/menu link, then the first
    ``ul.nav|menu`` link, whose href or text has an about keyword; else the
    first common path that exists in the corpus; else the page itself.
    The candidate paths are a fixed 11-row list, so "domain x paths" is a
    per-row array explode, not a join."""
    kw = alternation(ABOUT_LINK_KEYWORDS)
    pages = about_content_page(elements).withColumn(
        "domain", F.concat(url_scheme("url"), F.lit("://"), url_netloc("url")))
    # root pages of every site: crawled urls with an empty or "/" path
    is_root = F.col("url").rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*/?$")
    roots = (elements.filter((F.col("tag") == "[document]") & is_root)
             .groupBy(F.regexp_replace("url", "/$", "").alias("domain"))
             .agg(F.min("page_id").alias("root_id")))
    area1 = F.col("tag").isin("nav", "header", "menu")
    area2 = (F.col("tag") == "ul") & F.lower(F.array_join(F.coalesce("classes", F.array()), " ")).rlike("nav|menu")

    def hit(href):
        return F.lower(href).rlike(kw) | F.lower(py_strip("text")).rlike(kw)

    def area_links(cond, rank):
        ls = links_in_containers(elements, cond, hit(F.col("attrs")["href"]))
        return ls.filter(hit(F.col("href"))).select(F.col("page_id").alias("root_id"), F.lit(rank).alias("area"),
                                     "outer", "node_id", "href")
    nav = area_links(area1, 0).unionByName(area_links(area2, 1))
    if all_links_fallback:
        allk = with_text(elements, elements.filter((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull())).select(
            F.col("page_id").alias("root_id"), F.lit(2).alias("area"), F.lit(0).alias("outer"), "node_id",
            F.col("attrs")["href"].alias("href"), py_strip("text").alias("t"))
        allk = allk.filter(F.lower("href").rlike(kw) | F.lower("t").rlike(alternation(ABOUT_LINK_PHRASES)))
        nav = nav.unionByName(allk.drop("t"))
    first_nav = nav.groupBy("root_id").agg(
        F.min_by("href", F.struct("area", "outer", "node_id")).alias("nav_href"))
    # only sites whose root page was crawled are probed; the paths start with
    # "/", so a path is resolved by appending it to the site
    probes = pages.filter(~F.col("has_about_content")).join(roots.select("domain"), "domain", "left_semi").select(
        "page_id", F.posexplode(F.array(*[F.concat(F.col("domain"), F.lit(p)) for p in paths])).alias("prank", "probe_url"))
    existing = probes.join(corpus_urls.select(F.col("url").alias("probe_url")).distinct(), "probe_url",
                           "left_semi")
    first_path = existing.groupBy("page_id").agg(F.min_by("probe_url", "prank").alias("path_url"))
    # the navigation link is looked up by site, so pages without a crawled
    # root page do not meet on one NULL key
    site_nav = roots.join(first_nav, "root_id").select("domain", "nav_href")
    out = pages.join(site_nav, "domain", "left").join(first_path, "page_id", "left")
    nav_url = F.when(F.col("nav_href").isNotNull(), resolve_url("domain", "nav_href"))
    about = F.when(F.col("has_about_content"), F.col("url")).otherwise(
        F.coalesce(nav_url, F.col("path_url"), F.col("url")))
    src = (F.when(F.col("has_about_content"), "self").when(nav_url.isNotNull(), "navigation")
           .when(F.col("path_url").isNotNull(), "common_path").otherwise("fallback"))
    return out.select("page_id", "url", about.alias("about_url"), src.alias("found_by"))
