"""Video thumbnails (T1-T8) as column expressions.

The strategy ladder poster -> platform -> placeholder is one ``CASE``; the
placeholder is a constant data URL (folded once by the optimizer).
"""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import (
    DAILYMOTION_ID_PATTERN, DAILYMOTION_THUMB, PLACEHOLDER_SVG, THUMB_HEIGHT, THUMB_WIDTH,
    VIDEO_PLATFORMS, VIMEO_ID_PATTERNS, VIMEO_THUMB, WISTIA_ID_PATTERN, WISTIA_THUMB,
    YOUTUBE_ID_PATTERNS, YOUTUBE_THUMB, alternation,
)
from ..functions.urls import naive_resolve, url_netloc
from .topk import first_per_key

PLACEHOLDER_URL = "data:image/svg+xml;base64," + base64.b64encode(PLACEHOLDER_SVG.encode()).decode()


def _first_match(c: Column, patterns) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns])


def platform_thumbnail(video_url) -> Column:
    """Thumbnail URL from the platform id; host chosen by the netloc,
    id searched in the whole URL; NULL when the host matches but no id."""
    u = F.col(video_url) if isinstance(video_url, str) else video_url
    host = url_netloc(u)
    yt = _first_match(u, YOUTUBE_ID_PATTERNS)
    vm = _first_match(u, VIMEO_ID_PATTERNS)
    dm = _first_match(u, [DAILYMOTION_ID_PATTERN])
    wi = _first_match(u, [WISTIA_ID_PATTERN])

    def fmt(tpl, idc):
        a, b = tpl.split("{id}")
        return F.concat(F.lit(a), idc, F.lit(b))

    return (F.when(host.contains("youtube.com") | host.contains("youtu.be"), fmt(YOUTUBE_THUMB, yt))
            .when(host.contains("vimeo.com"), fmt(VIMEO_THUMB, vm))
            .when(host.contains("dailymotion.com"), fmt(DAILYMOTION_THUMB, dm))
            .when(host.contains("wistia.com") | host.contains("wistia.net"), fmt(WISTIA_THUMB, wi)))


def platform_name(video_url) -> Column:
    """T4: platform by substring of the whole URL."""
    u = F.col(video_url) if isinstance(video_url, str) else video_url
    return (F.when(u.contains("youtube.com") | u.contains("youtu.be"), "youtube")
            .when(u.contains("vimeo.com"), "vimeo")
            .when(u.contains("dailymotion.com"), "dailymotion")
            .when(u.contains("wistia.com") | u.contains("wistia.net"), "wistia")
            .otherwise("unknown"))


def thumbnail_struct(video_url, poster, base_url) -> Column:
    """``struct(thumbnail_url, thumbnail_type, source, width, height,
    is_placeholder)`` for one video."""
    u = F.col(video_url) if isinstance(video_url, str) else video_url
    p = F.col(poster) if isinstance(poster, str) else poster
    b = F.col(base_url) if isinstance(base_url, str) else base_url
    has_poster = F.coalesce(p, F.lit("")) != ""
    plat = platform_thumbnail(u)
    url = (F.when(has_poster, naive_resolve(p, b))
           .when(plat.isNotNull(), plat).otherwise(F.lit(PLACEHOLDER_URL)))
    ttype = F.when(has_poster, "poster").when(plat.isNotNull(), "platform").otherwise("placeholder")
    source = (F.when(has_poster, "existing_poster").when(plat.isNotNull(), platform_name(u))
              .otherwise("generated"))
    return F.struct(url.alias("thumbnail_url"), ttype.alias("thumbnail_type"),
                    source.alias("source"), F.lit(THUMB_WIDTH).alias("width"),
                    F.lit(THUMB_HEIGHT).alias("height"),
                    (~has_poster & plat.isNull()).alias("is_placeholder"))


def video_elements(elements: DataFrame) -> DataFrame:
    """Every ``video`` (src may be ""), then iframes whose raw src names a
    platform; raw (unresolved) url; ``seq`` keeps videos before iframes."""
    plat = alternation(VIDEO_PLATFORMS)
    src = F.coalesce(F.col("attrs")["src"], F.lit(""))
    v = elements.filter((F.col("tag") == "video") |
                        ((F.col("tag") == "iframe") & F.lower(src).rlike(plat)))
    return v.select(
        "page_id", F.col("url").alias("base_url"),
        F.when(F.col("tag") == "video", 0).otherwise(1).alias("seq"), "node_id",
        src.alias("video_url"),
        F.when(F.col("tag") == "video", "video").otherwise("iframe").alias("type"),
        F.coalesce(F.col("attrs")["poster"], F.lit("")).alias("poster"),
        F.coalesce(F.col("attrs")["title"], F.lit("")).alias("title"))


def video_thumbnails(elements: DataFrame) -> DataFrame:
    """T1+T6: one thumbnail row per video element, in reference order
    (``seq``, ``node_id``)."""
    v = video_elements(elements)
    t = thumbnail_struct("video_url", "poster", "base_url")
    return v.select("page_id", "seq", "node_id", "video_url", "type",
                    t["thumbnail_url"].alias("thumbnail_url"),
                    t["thumbnail_type"].alias("thumbnail_type"),
                    t["source"].alias("source"), t["width"].alias("width"),
                    t["height"].alias("height"), t["is_placeholder"].alias("is_placeholder"))


def attach_thumbnails(videos: DataFrame, thumbs: DataFrame) -> DataFrame:
    """Left join videos (page_id, url) to thumbnails on exact url,
    first thumbnail (reference order) per url only."""
    first = first_per_key(thumbs, ["page_id", "video_url"], ["seq", "node_id"])
    first = first.select("page_id", F.col("video_url").alias("url"), "thumbnail_url",
                         "thumbnail_type", F.col("source").alias("thumbnail_source"),
                         F.when(F.col("is_placeholder"), F.lit(True)).alias("is_placeholder_thumbnail"))
    return videos.join(first, ["page_id", "url"], "left")
