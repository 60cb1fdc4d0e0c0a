"""Q-B: the paginated media endpoint (split variant) for every page.

Per page: the flat scored media list (M6/M7 with thumbnails T8), sorted by
priority (W3), the slice after ``cursor`` (W5/W7), an optional post-slice
type filter (F10), the full-list summary (G1) and pagination meta (W9).

Skew: the page totals are a partial aggregate and the slice is a first-k of
``start + limit`` rows per page (WindowGroupLimit, applied before the
shuffle), so no page's whole media list is gathered in one task. The two
branches join on page_id with matching partitioning. The totals branch
types images, videos and icons by tag, so only iframe and anchor URLs are
resolved a second time. The nested item array
is bounded by ``limit`` (1..50, V6).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.media import pages_of, split_media, split_media_types
from ..operators.topk import first_k
from ..operators.paging import decode_text_cursor_value, encode_text_cursor

ITEM_FIELDS = ["id", "media_url", "type", "alt", "title", "width", "height", "priority", "context", "poster",
               "filename", "extension", "text", "rel", "sizes", "thumbnail_url", "thumbnail_type",
               "thumbnail_source", "is_placeholder_thumbnail"]
COUNTS = {"images_count": ["image"], "videos_count": ["video", "iframe"], "documents_count": ["document"],
          "icons_count": ["icon"]}


def media_endpoint(elements: DataFrame, cursor: str | None = None, limit: int = 20,
                   media_type: str | None = None) -> DataFrame:
    if not 1 <= limit <= 50:
        raise ValueError("limit must be within 1..50")
    start = decode_text_cursor_value(cursor)
    media = split_media(elements).withColumn("_pdesc", -F.col("priority"))
    t = F.col("type")
    # the page totals: a partial aggregate (each map task sends one row per
    # page) over the media types, which need URLs only for iframes and anchors
    counts = split_media_types(elements).groupBy("page_id").agg(
        F.count(F.lit(1)).alias("total_assets"),
        *[F.count_if(t.isin(*types)).alias(name) for name, types in COUNTS.items()])
    # the slice: positions only up to its end are needed, so a first-k
    # (WindowGroupLimit) keeps at most start + limit rows per page per task
    head = first_k(media, ["page_id"], ["_pdesc", "class_rank", "node_id"], start + limit, "pos")
    pos = F.col("pos")
    in_slice = pos > start
    keep = in_slice & (t == media_type) if media_type else in_slice
    item = F.struct(pos.alias("_o"), *[F.col(f) for f in ITEM_FIELDS])
    items = head.filter(in_slice).groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.when(keep, item))).alias("_items"),
        F.count(F.lit(1)).alias("current_page_count"))
    # a row for every page: one without media has an empty list and zero totals
    agg = pages_of(elements).join(counts, "page_id", "left").join(items, "page_id", "left").select(
        "page_id", F.coalesce("_items", F.array().cast(items.schema["_items"].dataType)).alias("_items"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("current_page_count", "total_assets", *COUNTS)])
    total = F.col("total_assets")
    end = F.least(F.lit(start + limit), total)
    has_more = end < total
    assets = F.transform("_items", lambda s: F.struct(*[s[f].alias(f) for f in ITEM_FIELDS]))
    return agg.select(
        F.lit(True).alias("success"), "page_id", assets.alias("media_assets"),
        F.struct("total_assets", *COUNTS, "current_page_count", has_more.alias("has_more")).alias("media_summary"),
        F.struct(F.when(has_more, encode_text_cursor(end)).alias("next_cursor"), has_more.alias("has_more"),
                 total.alias("total_count"), F.lit(start).alias("current_page_start"),
                 end.alias("current_page_end")).alias("pagination"))
