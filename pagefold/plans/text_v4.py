"""Q-C: the v4 text envelope for every page of a crawl.

page_title (P2, "Untitled Page"), url (P1), language (P4), summary (P10),
sections (P12), key/values (X5), media: first 20 image urls and first 10
videos with their thumbnail (M8, T1-T7). ``video_thumbnails`` (one row per
video element) stays a separate table; every array in the envelope is a
bounded first-k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_whitespace, extractive_summary, normalize_url
from ..operators.facts import key_values_array
from ..operators.media import simple_media
from ..operators.page import page_fields
from ..operators.sections import sections
from ..operators.thumbs import attach_thumbnails, video_thumbnails
from ..operators.topk import nest_ordered


def text_v4(elements: DataFrame, max_sections: int = 10, max_key_values: int = 10) -> DataFrame:
    f = page_fields(elements).select(
        "page_id", normalize_url("url").alias("url"),
        F.coalesce("title_raw", F.lit("Untitled Page")).alias("page_title"), "language",
        clean_whitespace("doc_text").alias("text"))
    f = f.withColumn("summary", extractive_summary("text", "page_title"))
    secs = nest_ordered(sections(elements, max_sections), ["page_id"], "ord",
                        ["name", "content_summary", "raw_excerpt"], "sections")
    f = f.withColumn("key_values", key_values_array("text", 10, max_key_values))
    # both media lists from one aggregate over the same first-k rows, so the
    # media rows (and their URL resolution) are computed once; thumbnails
    # (at most one per video url) are joined to the video rows first
    media = attach_thumbnails(simple_media(elements).withColumnRenamed("media_url", "url"),
                              video_thumbnails(elements))
    is_img, is_vid = F.col("kind") == "images", F.col("kind") == "videos"
    vfields = ["url", "thumbnail_url", "thumbnail_type", "thumbnail_source", "is_placeholder_thumbnail"]
    lists = media.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.when(is_img, F.struct(F.col("ord").alias("_o"), "url")))).alias("_i"),
        F.array_sort(F.collect_list(F.when(is_vid, F.struct(F.col("ord").alias("_o"), *vfields)))).alias("_v"))
    lists = lists.select("page_id", F.transform("_i", lambda s: s["url"]).alias("images"),
                         F.transform("_v", lambda s: F.struct(*[s[f].alias(f) for f in vfields])).alias("videos"))
    env = f.join(secs, "page_id", "left").join(lists, "page_id", "left")

    def empty(c, df):
        return F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)).alias(c)

    return env.select(
        F.lit(200).alias("statusCode"), "page_id", "page_title", "url", "language", "summary",
        empty("sections", secs), "key_values",
        F.struct(empty("images", lists), empty("videos", lists)).alias("media"))
