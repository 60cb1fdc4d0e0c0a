"""Q-A: the intelligent scrape (hybrid variant) for every page of a crawl.

Stages: page header (P2/P3/P7) -> About links in nav/header/footer (J1, A1)
-> fetch the top ``max_about_pages`` About pages from the crawl itself and
keep the longest text (J2, A7, A8) -> hybrid facts (X1/X2) -> media summary
(M1-M5, G2) -> AI gate (F11) -> one envelope row per page (S15).

Shuffle plan: one partial aggregate over the elements gives every page's
fields (one row per page leaves each map task); when the About pages are
looked up in the same crawl, their texts come from that same aggregate
(Spark reuses its shuffle) instead of a second pass. The top About links
per page are a first-k (WindowGroupLimit) and the link count a partial
aggregate, so no page's links are gathered in one task; the About lookup
is the one equi-join on url (AQE splits hot target urls), and only the texts
of linked pages take part in it (``linked_texts``). The best About
text, the analysis list and the found count come from a single per-page
aggregate over the few About candidates, and the main page is compared
with the best of them after the join on page_id, so the page text itself
is not shuffled again and the link URLs are resolved once. Every per-page
list in the envelope is bounded (About analysis by ``max_about_pages``);
the media lists stay a separate table (``hybrid_media``) and the summary
counts resolve URLs only for anchors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import INTELLIGENT_TEXT_CHARS
from ..functions.text import clean_whitespace, py_strip, truncate
from ..operators.facts import ai_gate, hybrid_facts
from ..operators.links import hybrid_about_links, page_texts
from ..operators.media import hybrid_counts
from ..operators.page import page_fields
from ..operators.topk import first_k, rows_per_key


def linked_texts(texts: DataFrame, corpus: DataFrame, top: DataFrame) -> DataFrame:
    """``about_url, about_title, about_text`` of the crawled pages that ``top`` links to, one page per url (a
    recrawl keeps the lowest page_id).

    The crawl is cut down to them before any text moves by url: the
    (page_id, url) rows of the document elements are semi-joined with the
    distinct target urls, and the page-field aggregate, which lies by page_id
    already, is joined with the page_ids found. (An inner join with distinct
    ids: a semi-join would be pushed below that aggregate, which then could
    not be shared.) Only the texts that are left are exchanged by url; that
    partitioning is the one the lookup join needs.
    """
    crawled = corpus.filter(F.col("tag") == "[document]").select("page_id", F.col("url").alias("about_url"))
    linked = crawled.join(top.select("about_url").distinct(), "about_url", "left_semi").select("page_id").distinct()
    payload = [c for c in texts.columns if c not in ("page_id", "about_url")]
    return texts.join(linked, "page_id").groupBy("about_url").agg(
        F.min_by(F.struct(*payload), "page_id").alias("t")).select("about_url", "t.about_title", "t.about_text")


def intelligent(elements: DataFrame, max_about_pages: int = 3, include_media: bool = True,
                force_ai: bool = False, corpus: DataFrame | None = None,
                corpus_texts: DataFrame | None = None) -> DataFrame:
    """``elements``: the parsed pages to answer for; ``corpus``: the parsed
    crawl the About pages are looked up in (defaults to ``elements``);
    ``corpus_texts``: that crawl's stored url-bucketed text table
    (``sources.tables.bucket_page_texts``), which makes the lookup join
    shuffle only the link side. Rows without a ``page_id`` belong to no page
    and are left out."""
    elements = elements.filter("page_id IS NOT NULL")
    fields = page_fields(elements).select(
        "page_id", "url", "title_raw",
        F.coalesce("title_raw", F.lit("No title found")).alias("title"),
        F.coalesce("description_raw", F.lit("No description found")).alias("description"),
        clean_whitespace("doc_text").alias("text"))
    if corpus is None and corpus_texts is None:
        # carries the description too, in the envelope's column order, so
        # this branch and the envelope need the same page-field aggregate and
        # Spark reuses its shuffle (the page texts are shuffled once)
        texts = fields.select("page_id", F.col("url").alias("about_url"),
                              F.coalesce("title_raw", F.lit("")).alias("about_title"),
                              F.col("description").alias("_description"), F.col("text").alias("about_text"))
    elif corpus_texts is None:
        texts = page_texts(corpus).select(F.col("about_page_id").alias("page_id"), "about_url",
                                          "about_title", "about_text")
    # the first max_about_pages About links per page (a first-k: each map
    # task keeps at most that many per page, so a page with a huge share of
    # all links is never gathered in one task) and every page's link count
    # (a partial aggregate). Both read the same deduplicating link aggregate,
    # whose exchange Spark reuses. The top links are looked up (left join:
    # unfetchable links still count as found) and everything folds into one
    # per-page aggregate.
    links = hybrid_about_links(elements)
    top = first_k(links, ["page_id"], ["sort_key"], max_about_pages, "rank").select(
        "page_id", "rank", "about_url", "confidence")
    if corpus_texts is not None:
        texts = corpus_texts.select("about_url", "about_title", "about_text")
    else:
        texts = linked_texts(texts, elements if corpus is None else corpus, top)
    found = rows_per_key(links, ["page_id"], "found")
    fetched = top.join(texts, "about_url", "left")
    got = F.col("about_text").isNotNull()
    cand = fetched.select(
        "page_id", "rank", F.col("about_url").alias("cand_url"), F.length("about_text").alias("cand_len"),
        F.col("about_text").alias("cand_text"),
        F.when(got, F.struct("rank", F.col("about_url").alias("url"), py_strip("about_title").alias("title"),
                             F.length("about_text").alias("content_length"), "confidence")).alias("a"),
        F.lit(None).cast("long").alias("found"))
    counts = found.select("page_id", F.lit(None).cast("int").alias("rank"),
                          F.lit(None).cast("string").alias("cand_url"), F.lit(None).cast("int").alias("cand_len"),
                          F.lit(None).cast("string").alias("cand_text"),
                          F.lit(None).cast(cand.schema["a"].dataType).alias("a"), "found")
    order = F.when(F.col("cand_len").isNotNull(), F.struct("cand_len", -F.col("rank")))
    per_page = cand.unionByName(counts).groupBy("page_id").agg(
        # The longest fetched About text, ties keeping the earlier rank
        F.max_by(F.struct("cand_url", "cand_text", "cand_len"), order).alias("b"),
        # Fetched About pages in rank order (at most max_about_pages)
        F.array_sort(F.collect_list("a")).alias("analysis"),
        # Every About link found, fetched or not
        F.max("found").alias("about_pages_found"))
    analysis_t = per_page.schema["analysis"].dataType
    env = fields.join(per_page, "page_id", "left")
    # An About text replaces the main page's only when strictly longer
    # (the main page is the earliest candidate)
    about_wins = F.col("b.cand_len").isNotNull() & (F.length("text").isNull() | (F.col("b.cand_len") > F.length("text")))
    env = env.withColumn("best_about_url", F.when(about_wins, F.col("b.cand_url")).otherwise(F.col("url")))
    env = env.withColumn("best_text", F.when(about_wins, F.col("b.cand_text")).otherwise(F.col("text"))).withColumn("company_info", hybrid_facts("best_text"))
    env = env.withColumn("ai_enhancement", ai_gate(F.col("company_info"), "best_text", force_ai))
    analysis = F.transform(F.coalesce("analysis", F.array().cast(analysis_t)),
                           lambda a: F.struct(a["url"].alias("url"), a["title"].alias("title"),
                                              a["content_length"].alias("content_length"),
                                              a["confidence"].alias("confidence")))
    cols = [
        F.lit(True).alias("success"), "page_id", "url", "best_about_url", "title", "description",
        truncate("best_text", INTELLIGENT_TEXT_CHARS).alias("content"), "company_info",
        F.coalesce("about_pages_found", F.lit(0)).alias("about_pages_found"),
        analysis.alias("about_page_analysis"),
        "ai_enhancement",
        F.when(F.col("ai_enhancement.used"), "ai_enhanced").otherwise("programmatic").alias("approach_used"),
    ]
    if include_media:
        summary = hybrid_counts(elements)
        env = env.join(summary, "page_id", "left")
        cols.append(F.struct(*[F.coalesce(c, F.lit(0)).alias(c) for c in
                               ("total_assets", "images_count", "videos_count", "documents_count",
                                "icons_count")]).alias("media_summary"))
    return env.select(*cols)
