"""The service's media request for every page: list, store, score, page.

M9's media list, the first of each URL (W1), stored by content (S7), scored
by context and size (M17), ordered by priority (W3), one slice by JSON cursor
with the service's page meta (W9s). Media that could not be fetched are left
out, as one failed download does not fail the request.

Skew: the list is cut by (page, url), the slice is a first-k of ``start +
limit`` rows a page before its shuffle, totals are partial counts. Contents
stay in the table of fetched media: only their hashes and sizes are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.media import pages_of, priority_root_svc, svc_media
from ..operators.paging import decode_json_cursor_value, page_meta_service
from ..operators.topk import first_k
from ..sources.sinks import store_key, url_extension
from ..functions.urls import content_hash


def service_media(elements: DataFrame, fetched: DataFrame, cdn_domain: str, cursor: str | None = None,
                  limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """(items, meta) of one result page for every ``page_id``.

    ``fetched`` has a row for each fetched URL: ``media_url``, ``content``,
    ``width``, ``height``; a URL that it lacks, or with null content, is left
    out. Items: ``page_id``, ``pos``, ``url`` (at the CDN), ``type``,
    ``context``, ``filename``, ``size_bytes``, ``priority``. Meta: a row for every
    page, also one without media. Ties of priority keep page order. A cursor
    that does not decode, or a limit outside 1..50, is an error.
    """
    start, valid = decode_json_cursor_value(cursor)
    if not valid:
        raise ValueError("Invalid cursor")
    if not 1 <= limit <= 50:
        raise ValueError("limit must be within 1..50")
    start = max(start, 0)
    first = svc_media(elements).groupBy("page_id", "media_url").agg(
        F.min_by(F.struct("type", "context"), "node_id").alias("v"), F.min("node_id").alias("node_id"))
    sizes = fetched.filter(F.col("content").isNotNull()).select(
        "media_url", "width", "height", F.octet_length("content").alias("size_bytes"),
        content_hash("content", "media_url").alias("digest"))
    items = first.select("page_id", "media_url", "node_id", "v.type", "v.context").join(sizes, "media_url").withColumn(
        "filename", store_key(F.col("digest"), url_extension("media_url"), F.col("type")))
    items = items.withColumn("priority", priority_root_svc("context", "width", "height"))
    head = first_k(items, ["page_id"], [F.col("priority").desc(), "node_id"], start + limit, "pos")
    shown = head.filter(F.col("pos") > start).select(
        "page_id", "pos", F.concat(F.lit(f"https://{cdn_domain}/"), "filename").alias("url"), "type", "context",
        "filename", "size_bytes", "priority")
    totals = pages_of(elements).join(items.groupBy("page_id").agg(F.count("*").alias("total_count")), "page_id", "left")
    totals = totals.select("page_id", F.coalesce("total_count", F.lit(0)).alias("total_count"))
    meta = page_meta_service("total_count", F.lit(start), limit)
    return shown, totals.select("page_id", "total_count", *[c.alias(n) for n, c in meta.items()])
