"""Rules applied to fetched media.

The fetch itself (HTTP, ffprobe, image decoding) is not part of the
engine; these operators run on a table of fetched-media facts
``(url, content_type, size_bytes, width, height, duration_seconds,
bitrate)`` — e.g. the join of ``binaryFile``/``image`` scans (S6) with the
media rows — and are all built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import (
    ALLOWED_MIME, APP_VIDEO_FORMATS, BASE64_MAX_BYTES, MAX_CONTENT_LENGTH, MAX_VIDEO_MB, MAX_VIDEO_SECONDS,
    MIN_IMAGE_SIDE_PX, VIDEO_FORMATS,
)
from ..functions.urls import url_path


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stable_bucket(url) -> Column:
    """Q6: the reference names unnamed files with Python's per-process salted
    ``hash(url) % 10000``; this uses a stable number from md5(url)."""
    return (F.conv(F.substring(F.md5(_c(url)), 1, 8), 16, 10).cast("long") % 10000)


def media_filename(url, content_type) -> Column:
    """Basename of the URL path; if empty or without "." then
    ``video_<n>.mp4`` (content type mentions video) or ``image_<n>.jpg``."""
    base = F.element_at(F.split(url_path(_c(url)), "/"), -1)
    ct = F.lower(F.coalesce(_c(content_type), F.lit("")))
    n = stable_bucket(url).cast("string")
    fallback = F.when(ct.contains("video"), F.concat(F.lit("video_"), n, F.lit(".mp4"))).otherwise(
        F.concat(F.lit("image_"), n, F.lit(".jpg")))
    return F.when((base == "") | ~base.contains("."), fallback).otherwise(base)


def file_ext(filename) -> Column:
    return F.element_at(F.split(F.lower(_c(filename)), r"\."), -1)


def media_kind(filename) -> Column:
    """Video if the extension is a video format, else image."""
    return F.when(file_ext(filename).isin(*VIDEO_FORMATS), "video").otherwise("image")


def mime_admitted(content_type, size, max_size: int = MAX_CONTENT_LENGTH, allowed=ALLOWED_MIME,
                  duration=None, max_video_duration: float = MAX_VIDEO_SECONDS) -> Column:
    """F7 (H5 limits): content type contains an allowed MIME type, size <=
    ``max_size`` (10 MB by default) and, for videos with a known duration,
    duration <= ``max_video_duration``."""
    ct = F.lower(F.coalesce(_c(content_type), F.lit("")))
    ok = None
    for m in allowed:
        ok = ct.contains(m) if ok is None else (ok | ct.contains(m))
    ok = ok & (_c(size) <= max_size)
    if duration is not None:
        ok = ok & ~(ct.startswith("video/") & F.coalesce(_c(duration) > max_video_duration, F.lit(False)))
    return ok


def app_kept(filename, size, width, height, duration, bitrate) -> Column:
    """F8+F9 (app): over 10 MB dropped; listed video formats need a known
    duration <= 300 s and bitrate*duration/(8*1024^2) <= 50 MB; images with
    a known side under 100 px are dropped."""
    ext = file_ext(filename)
    is_video = ext.isin(*APP_VIDEO_FORMATS)
    mb = _c(bitrate) * _c(duration) / (8 * 1024 * 1024)
    video_ok = _c(duration).isNotNull() & (_c(duration) <= MAX_VIDEO_SECONDS) & (mb <= MAX_VIDEO_MB)
    small = (_c(width) < MIN_IMAGE_SIDE_PX) | (_c(height) < MIN_IMAGE_SIDE_PX)
    kind = media_kind(filename)
    return ((_c(size) <= MAX_CONTENT_LENGTH) & F.when(is_video, F.coalesce(video_ok, F.lit(False)))
            .otherwise(~((kind == "image") & F.coalesce(small, F.lit(False)))))


def base64_payload(content, size, include: bool) -> Column:
    """base64 of the content only when asked and under 5,000,000 bytes."""
    if not include:
        return F.lit(None).cast("string")
    return F.when(_c(size) < BASE64_MAX_BYTES, F.base64(_c(content)))


def media_asset(df: DataFrame) -> DataFrame:
    """The service's MediaAsset — type from the allowed MIME lists,
    width/height default 800x600, format = MIME subtype, priority 80,
    context "<Type> from <url>"."""
    ct = F.lower(F.coalesce(F.col("content_type"), F.lit("")))
    is_img = None
    for m in [x for x in ALLOWED_MIME if x.startswith("image/")]:
        is_img = ct.contains(m) if is_img is None else (is_img | ct.contains(m))
    t = F.when(is_img, "image").otherwise("video")
    return df.select(
        "*", t.alias("asset_type"),
        F.coalesce("width", F.lit(800)).alias("asset_width"),
        F.coalesce("height", F.lit(600)).alias("asset_height"),
        F.element_at(F.split(F.col("content_type"), "/"), -1).alias("asset_format"),
        F.lit(80).alias("asset_priority"),
        F.concat(F.initcap(t), F.lit(" from "), F.col("url")).alias("asset_context"))
