"""The remaining per-page envelopes (S15): hybrid fast scrape, split text
scrape, basic scrape and basic About scrape. Each is one pass of page
fields plus bounded per-page lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BASIC_TEXT_CHARS, SPLIT_TEXT_CHARS
from ..functions.text import clean_whitespace, truncate
from ..operators.facts import basic_facts, hybrid_facts, split_facts
from ..operators.links import split_about_links
from ..operators.media import hybrid_counts
from ..operators.page import link_list, page_fields
from ..operators.topk import first_k, nest_ordered, rows_per_key


def fast_scrape(elements: DataFrame, include_media: bool = True) -> DataFrame:
    """Hybrid ``/scrape/fast``: header, page text (2000 chars), hybrid facts
    on the page text and, optionally, the media summary; no AI."""
    f = page_fields(elements).withColumn("text", clean_whitespace("doc_text"))
    out = f.select(
        "page_id", "url", F.coalesce("title_raw", F.lit("No title found")).alias("title"),
        F.coalesce("description_raw", F.lit("No description found")).alias("description"),
        truncate("text", SPLIT_TEXT_CHARS).alias("content"), hybrid_facts("text").alias("company_info"),
        F.lit("fast_programmatic").alias("approach_used"))
    if include_media:
        s = hybrid_counts(elements)
        out = out.join(s, "page_id", "left").select(
            *[c for c in out.columns],
            F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in
                       ("total_assets", "images_count", "videos_count", "documents_count", "icons_count")])
            .alias("media_summary"))
    return out


def split_text(elements: DataFrame, top_n: int = 3) -> DataFrame:
    """Split ``/scrape/text``: header (description "" when missing), main
    content (2000 chars), split facts, About links found and the top 3."""
    f = page_fields(elements).withColumn("main", clean_whitespace("main_text"))
    links = split_about_links(elements)
    # the top links are a first-k and the count a partial aggregate (no
    # page's links gathered in one task); both read the deduplicating link
    # aggregate, whose exchange Spark reuses
    kept = first_k(links, ["page_id"], ["sort_key"], top_n, "rank").withColumnRenamed("about_url", "url")
    found = rows_per_key(links, ["page_id"], "about_pages_found")
    packed = F.struct(F.col("rank").alias("_o"), "url", "title", "relevance_score")
    top = kept.groupBy("page_id").agg(F.array_sort(F.collect_list(packed)).alias("_a"))
    top = top.join(found, "page_id").select("page_id", "about_pages_found", F.transform("_a", lambda x: F.struct(
        x["url"].alias("url"), x["title"].alias("title"), x["relevance_score"].alias("relevance_score")))
        .alias("about_page_analysis"))
    env = f.join(top, "page_id", "left")
    return env.select(
        "page_id", "url", F.coalesce("title_raw", F.lit("No title found")).alias("title"),
        F.coalesce("description_raw", F.lit("")).alias("description"),
        truncate("main", SPLIT_TEXT_CHARS).alias("content"), split_facts("main").alias("company_info"),
        F.coalesce("about_pages_found", F.lit(0)).alias("about_pages_found"),
        F.coalesce("about_page_analysis", F.array().cast(top.schema["about_page_analysis"].dataType))
         .alias("about_page_analysis"),
        F.lit("programmatic_only").alias("approach_used"))


def basic_scrape(elements: DataFrame) -> DataFrame:
    """Basic ``/scrape``: title, description, page text (1000 chars) and the
    first 10 links with text."""
    f = page_fields(elements)
    links = nest_ordered(link_list(elements, 10), ["page_id"], "ord", ["text", "url"], "links")
    env = f.join(links, "page_id", "left")
    return env.select(
        "page_id", "url", F.coalesce("title_raw", F.lit("No title found")).alias("title"),
        F.coalesce("description_raw", F.lit("No description found")).alias("description"),
        truncate(clean_whitespace("doc_text"), BASIC_TEXT_CHARS).alias("text_content"),
        F.coalesce("links", F.array().cast(links.schema["links"].dataType)).alias("links"))


def basic_about(elements: DataFrame) -> DataFrame:
    """Basic ``/scrape/about``: title, main content (2000 chars) and the
    three basic facts (X4)."""
    f = page_fields(elements).withColumn("main", clean_whitespace("main_text"))
    return f.select("page_id", "url", F.coalesce("title_raw", F.lit("No title found")).alias("title"),
                    truncate("main", SPLIT_TEXT_CHARS).alias("content"), basic_facts("main").alias("company_info"))
