"""Media extraction and scoring.

Each variant is ONE filter + projection over the element table: the media
class is a ``CASE`` on the tag, so images, videos, documents and icons come
out of a single scan instead of a union of per-class scans. Document order
(``node_id``) plus a class rank reproduce the reference's list order, so
its stable sorts become ``ORDER BY priority DESC, class_rank, node_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import (
    BACKGROUND_URL_REGEX, BRANDING_KEYWORDS, CONTEXT_DEFAULT_PRIORITY, CONTEXT_TIERS_CLASSIC,
    CONTEXT_TIERS_ROOT_SVC, CONTEXT_TIERS_SERVICE, DOCUMENT_EXTENSIONS, HYBRID_HIGH_IMAGE_WORDS, ICON_RELS,
    LARGE_SIDE_PX, MIN_IMAGE_SIDE_PX, SPLIT_IMAGE_DEFAULT, SPLIT_IMAGE_LADDER, SPLIT_IMAGE_NOT_UI,
    SPLIT_PRIORITY, SQUARE_RATIO, UI_EXCLUSIONS, UI_EXCLUSIONS_SPLIT, VIDEO_FORMATS, VIDEO_HINTS, alternation,
    sql_array,
)
from ..functions.text import py_strip
from ..sources.html import with_text
from ..functions.urls import media_id, path_extension, resolve_url, url_path
from .thumbs import thumbnail_struct
from .topk import first_k


def _attr(name: str) -> Column:
    return F.col("attrs")[name]


def _nz(c: Column) -> Column:
    """Python truthiness of an optional string: NULL or "" -> NULL."""
    return F.nullif(c, F.lit(""))


def lazy_src() -> Column:
    """``src or data-src or data-lazy-src``."""
    return F.coalesce(_nz(_attr("src")), _nz(_attr("data-src")), _nz(_attr("data-lazy-src")))


def could_be_document(href) -> Column:
    """False only when the raw href alone proves its resolved URL cannot end
    in a document extension: its own path is non-empty, has no "." / ".."
    segments and its extension is not a document one (resolution keeps the
    last path segment then). Anchors failing this skip URL resolution."""
    h = F.col(href) if isinstance(href, str) else href
    path = url_path(h)
    dot_segment = path.rlike(r"(^|/)\.\.?(/|$)")
    return (path == "") | dot_segment | path_extension(path).isin(*DOCUMENT_EXTENSIONS)


def _contains_any(c: Column, words) -> Column:
    return c.rlike(alternation(words))


# ------------------------------------------------------------------ split (M6)
CLASS_RANK = {"image": 0, "video": 1, "document": 2, "icon": 3}


def split_media(elements: DataFrame) -> DataFrame:
    """The split variant's flat media list, one row
    per item with ``priority`` and ``class_rank``; the list order is (priority desc, class_rank,
    document order)."""
    tag = F.col("tag")
    vsrc = F.coalesce(_nz(_attr("src")), _nz(_attr("data-src")))
    href = _attr("href")
    ref = (F.when(tag == "img", lazy_src())
           .when(tag.isin("video", "iframe"), vsrc)
           .when(tag.isin("a", "link"), _nz(href)))
    cand = elements.filter(
        tag.isin("img", "video", "iframe", "a", "link")
        & ~((tag == "link") & ~F.arrays_overlap(F.col("rel"), F.array(*[F.lit(r) for r in ICON_RELS])))
        & ((tag != "a") | could_be_document(href))
    )
    # only documents show a text; the other tags' rows are not text-bearing
    cand = with_text(elements, cand.filter(tag == "a")).unionByName(cand.filter(tag != "a")).select(
             "page_id", "url", "node_id", "tag", "attrs", "classes", "rel",
             py_strip("text").alias("link_text"), ref.alias("ref")).filter(F.col("ref").isNotNull())
    cand = cand.withColumn("full_url", resolve_url("url", "ref"))
    path = url_path("full_url")
    ext = path_extension(path)
    lower_url = F.lower("full_url")
    is_video = (tag == "video") | _contains_any(lower_url, VIDEO_HINTS)
    is_doc = ext.isin(*DOCUMENT_EXTENSIONS)
    mtype = (F.when(tag == "img", "image")
             .when(tag.isin("video", "iframe") & is_video, F.when(tag == "video", "video").otherwise("iframe"))
             .when((tag == "a") & is_doc, "document")
             .when(tag == "link", "icon"))
    alt = F.coalesce(_attr("alt"), F.lit(""))
    alt_l = F.lower(alt)
    class_l = F.lower(F.array_join(F.coalesce(F.col("classes"), F.array()), " "))
    img_priority = None
    for field, words, score in SPLIT_IMAGE_LADDER:          # M7, in this order
        cond = _contains_any(alt_l if field == "alt" else class_l, words)
        img_priority = F.when(cond, score) if img_priority is None else img_priority.when(cond, score)
    img_priority = (img_priority.when(~_contains_any(lower_url, UI_EXCLUSIONS_SPLIT), SPLIT_IMAGE_NOT_UI)
                    .otherwise(SPLIT_IMAGE_DEFAULT))
    title = F.coalesce(_attr("title"), F.lit(""))
    poster = F.coalesce(_attr("poster"), F.lit(""))
    out = cand.withColumn("type", mtype).filter(F.col("type").isNotNull())
    t = F.col("type")
    priority = (F.when(t == "image", img_priority).when(t.isin("video", "iframe"), SPLIT_PRIORITY["video"])
                .when(t == "document", SPLIT_PRIORITY["document"]).otherwise(SPLIT_PRIORITY["icon"]))
    context = (F.when(t == "image", F.when(alt_l != "", alt_l).otherwise("Image"))
               .when(t.isin("video", "iframe"), F.when(title != "", title).otherwise("Video"))
               .when(t == "document", F.when(F.col("link_text") != "", F.col("link_text"))
                     .otherwise(F.concat(F.lit("Document ("), F.upper(ext), F.lit(")"))))
               .otherwise("Favicon/Icon"))
    rank = F.when(t == "image", 0).when(t.isin("video", "iframe"), 1).when(t == "document", 2).otherwise(3)
    thumb = F.when(t.isin("video", "iframe"), thumbnail_struct("full_url", poster, "url"))
    doc = t == "document"
    vid = t.isin("video", "iframe")
    img = t == "image"
    return out.select(
        "page_id", F.col("url").alias("page_url"), "node_id",
        media_id("full_url").alias("id"), F.col("full_url").alias("media_url"), "type",
        priority.alias("priority"), context.alias("context"), rank.alias("class_rank"),
        F.when(img, alt).alias("alt"),
        F.when(img | vid, title).alias("title"),
        F.when(img, F.coalesce(_attr("width"), F.lit(""))).alias("width"),
        F.when(img, F.coalesce(_attr("height"), F.lit(""))).alias("height"),
        F.when(vid, poster).alias("poster"),
        F.when(doc, F.element_at(F.split(path, "/"), -1)).alias("filename"),
        F.when(doc, ext).alias("extension"),
        F.when(doc, F.col("link_text")).alias("text"),
        F.when(t == "icon", F.col("rel")).alias("rel"),
        F.when(t == "icon", F.coalesce(_attr("sizes"), F.lit(""))).alias("sizes"),
        thumb["thumbnail_url"].alias("thumbnail_url"),
        thumb["thumbnail_type"].alias("thumbnail_type"),
        thumb["source"].alias("thumbnail_source"),
        F.when(thumb["is_placeholder"], F.lit(True)).alias("is_placeholder_thumbnail"),
    )


def split_media_types(elements: DataFrame) -> DataFrame:
    """``(page_id, type)`` for every row of ``split_media`` without resolving
    URLs where the type does not depend on them: an ``img`` with a source is
    an image, a ``video`` with a source a video, an icon ``link`` with an
    href an icon. Only ``iframe`` and ``a`` rows (video hints and document
    extensions are read from the resolved URL) go through ``split_media``."""
    tag = F.col("tag")
    vsrc = F.coalesce(_nz(_attr("src")), _nz(_attr("data-src")))
    icon = F.arrays_overlap(F.col("rel"), F.array(*[F.lit(r) for r in ICON_RELS])) & _nz(_attr("href")).isNotNull()
    known = (F.when((tag == "img") & lazy_src().isNotNull(), "image")
             .when((tag == "video") & vsrc.isNotNull(), "video")
             .when((tag == "link") & icon, "icon"))
    by_tag = elements.filter(tag.isin("img", "video", "link")).select("page_id", known.alias("type")).filter(
        F.col("type").isNotNull())
    by_url = split_media(elements.filter(tag.isin("iframe", "a"))).select("page_id", "type")
    return by_tag.unionByName(by_url)


def pages_of(elements: DataFrame) -> DataFrame:
    """The ``page_id`` of every parsed page, with or without media."""
    return elements.filter(F.col("tag") == "[document]").select("page_id")


def media_summary(media: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """G1: per-page counts over ALL media of the split list. With ``pages``
    (``pages_of`` the elements) a page without media has a row of zeros."""
    t = F.col("type")
    counts = media.groupBy("page_id").agg(
        F.count("*").alias("total_assets"),
        F.count_if(t == "image").alias("images_count"),
        F.count_if(t.isin("video", "iframe")).alias("videos_count"),
        F.count_if(t == "document").alias("documents_count"),
        F.count_if(t == "icon").alias("icons_count"))
    return counts if pages is None else pages.join(counts, "page_id", "left").fillna(0)


# ----------------------------------------------------------------- hybrid (M1-M5)
def hybrid_media(elements: DataFrame) -> DataFrame:
    """M1-M5: the hybrid variant's five media lists as one table with
    ``kind`` in images/videos/audio/documents/icons. Images get priority
    high/medium (M1); videos are every video/iframe with a src (M2)."""
    tag = F.col("tag")
    vsrc = F.coalesce(_nz(_attr("src")), _nz(_attr("data-src")))
    ref = (F.when(tag == "img", lazy_src())
           .when(tag.isin("video", "iframe"), vsrc)
           .when(tag == "audio", _nz(_attr("src")))
           .when(tag.isin("a", "link"), _nz(_attr("href"))))
    anchors = elements.filter((tag == "a") & could_be_document(_nz(_attr("href"))))
    cand = with_text(elements, anchors).unionByName(elements.filter(tag.isin("img", "video", "iframe", "audio", "link"))).select(
        "page_id", "url", "node_id", "tag", "attrs", "classes", "rel",
        py_strip("text").alias("link_text"), ref.alias("ref")).filter(F.col("ref").isNotNull())
    cand = cand.filter((tag != "link") | F.arrays_overlap(F.col("rel"), F.array(*[F.lit(r) for r in ICON_RELS])))
    cand = cand.withColumn("full_url", resolve_url("url", "ref"))
    path = url_path("full_url")
    ext = path_extension(path)
    kind = (F.when(tag == "img", "images").when(tag.isin("video", "iframe"), "videos")
            .when(tag == "audio", "audio")
            .when((tag == "a") & ext.isin(*DOCUMENT_EXTENSIONS), "documents")
            .when(tag == "link", "icons"))
    classes = F.coalesce(F.col("classes"), F.array())
    alt = F.coalesce(_attr("alt"), F.lit(""))
    img_high = _contains_any(F.lower(F.concat(alt, F.lit(" "), F.array_join(classes, " "))),
                             HYBRID_HIGH_IMAGE_WORDS)
    k = F.col("kind")
    return cand.withColumn("kind", kind).filter(k.isNotNull()).select(
        "page_id", "node_id", "kind", F.col("full_url").alias("media_url"),
        F.when(k == "images", alt).alias("alt"),
        F.when(k.isin("images", "videos", "audio", "documents"),
               F.coalesce(_attr("title"), F.lit(""))).alias("title"),
        F.when(k == "images", F.coalesce(_attr("width"), F.lit(""))).alias("width"),
        F.when(k == "images", F.coalesce(_attr("height"), F.lit(""))).alias("height"),
        F.when(k.isin("images", "videos", "audio"), classes).alias("class"),
        F.when(k == "images", F.when(img_high, "high").otherwise("medium")).alias("priority"),
        F.when(k == "videos", F.when(tag == "video", "video").otherwise("iframe")).alias("type"),
        F.when(k == "videos", F.coalesce(_attr("poster"), F.lit(""))).alias("poster"),
        F.when(k == "documents", F.element_at(F.split(path, "/"), -1)).alias("filename"),
        F.when(k == "documents", ext).alias("extension"),
        F.when(k == "documents", F.col("link_text")).alias("text"),
        F.when(k == "icons", F.col("rel")).alias("rel"),
        F.when(k == "icons", F.coalesce(_attr("sizes"), F.lit(""))).alias("sizes"),
        F.when(k == "icons", F.coalesce(_attr("type"), F.lit(""))).alias("icon_type"),
        # Images high first, stable
        F.when((k == "images") & img_high, 0).otherwise(1).alias("image_rank"),
    )


def hybrid_counts(elements: DataFrame) -> DataFrame:
    """G2 straight from the elements: the same counts as
    ``hybrid_summary(hybrid_media(...))`` but URLs are resolved only for
    anchors (a document is decided by the resolved path's extension); the
    other kinds are decided by tag and attributes alone."""
    tag = F.col("tag")
    vsrc = F.coalesce(_nz(_attr("src")), _nz(_attr("data-src")))
    icon = (tag == "link") & F.arrays_overlap(F.col("rel"), F.array(*[F.lit(r) for r in ICON_RELS])) \
        & _nz(_attr("href")).isNotNull()
    kind = (F.when((tag == "img") & lazy_src().isNotNull(), "images")
            .when(tag.isin("video", "iframe") & vsrc.isNotNull(), "videos")
            .when((tag == "audio") & _nz(_attr("src")).isNotNull(), "audio")
            .when(icon, "icons"))
    other = elements.filter(tag.isin("img", "video", "iframe", "audio", "link")).select(
        "page_id", kind.alias("kind")).filter(F.col("kind").isNotNull())
    a = elements.filter((tag == "a") & (_nz(_attr("href")).isNotNull()) & could_be_document(_attr("href"))).select(
        "page_id", resolve_url("url", _attr("href")).alias("full_url"))
    docs = a.filter(path_extension(url_path("full_url")).isin(*DOCUMENT_EXTENSIONS)).select(
        "page_id", F.lit("documents").alias("kind"))
    return hybrid_summary(other.unionByName(docs))


def hybrid_summary(media: DataFrame) -> DataFrame:
    """Total over all five lists (audio included), per-list counts."""
    k = F.col("kind")
    return media.groupBy("page_id").agg(
        F.count("*").alias("total_assets"),
        F.count_if(k == "images").alias("images_count"),
        F.count_if(k == "videos").alias("videos_count"),
        F.count_if(k == "documents").alias("documents_count"),
        F.count_if(k == "icons").alias("icons_count"))


# ------------------------------------------------------------------- v4 (M8)
def simple_media(elements: DataFrame, max_images: int = 20, max_videos: int = 10) -> DataFrame:
    """M8: image urls (first 20) and video urls passing F3 (first 10) per page
    as rows ``(page_id, kind, ord, url)``."""
    # only img/video/iframe rows can be images or videos: skip anchors/links
    # before the url resolution instead of after it
    m = split_media(elements.filter(F.col("tag").isin("img", "video", "iframe")))
    m = m.filter(F.col("type").isin("image", "video", "iframe"))
    m = m.withColumn("kind", F.when(F.col("type") == "image", "images").otherwise("videos"))
    # one first-k window per (page, kind) keeps both lists in one pass
    top = first_k(m, ["page_id", "kind"], ["node_id"], max(max_images, max_videos), "ord")
    cap = F.when(F.col("kind") == "images", max_images).otherwise(max_videos)
    return top.filter(F.col("ord") <= cap).select("page_id", "kind", "ord", "media_url")


# ------------------------------------------------------------------ svc (M9)
def svc_media(elements: DataFrame) -> DataFrame:
    """``img[src]`` with context alt -> title -> parent text (strip,
    first 100 chars, if different from src) -> "Image"; ``video/iframe[src]``
    with context title -> "Video". Parent text comes with the image's
    row (``parent_head``), so nothing is joined."""
    tag = F.col("tag")
    m = elements.filter(tag.isin("img", "video", "iframe") & (F.coalesce(_attr("src"), F.lit("")) != ""))
    j = m.select("page_id", "url", "node_id", "tag", _attr("src").alias("src"), _attr("alt").alias("alt"),
                 _attr("title").alias("title"), F.col("parent_head").alias("parent_text"))
    pt = F.col("parent_text")
    img_ctx = F.coalesce(_nz(F.col("alt")), _nz(F.col("title")),
                         F.when(_nz(pt).isNotNull() & (pt != F.col("src")), pt), F.lit("Image"))
    vid_ctx = F.coalesce(_nz(F.col("title")), F.lit("Video"))
    return j.select("page_id", "node_id", resolve_url("url", "src").alias("media_url"),
                    F.when(tag == "img", "image").otherwise("video").alias("type"),
                    F.when(tag == "img", img_ctx).otherwise(vid_ctx).alias("context"))


# -------------------------------------------------------------- classic
#: The labels of branding and other images, with what stands in for an empty alt text.
CLASSIC_LABELS = {
    "api": (("Company image: ", "Branding content"), ("Content image: ", "Page content")),
    "app": (("Image: ", "Company image"), ("Image: ", "Content image")),
}


def classic_media(elements: DataFrame, variant: str = "api") -> DataFrame:
    """Raw (unresolved) media refs with a context label, from
    one scan: branding images first-class, UI images dropped, video/source
    tags, CSS background images of div/section/header. Each element yields an
    array of items (backgrounds can be several), exploded once; ``pass_no``
    and ``sub`` keep the reference's three-pass order (images, videos,
    backgrounds). ``variant`` chooses the labels of images (api, app)."""
    tag = F.col("tag")
    src = lazy_src()
    alt_l = F.lower(F.coalesce(_attr("alt"), F.lit("")))
    src_l = F.lower(src)
    brand = _contains_any(alt_l, BRANDING_KEYWORDS) | _contains_any(src_l, BRANDING_KEYWORDS)
    ui = _contains_any(src_l, UI_EXCLUSIONS)
    label = F.when(alt_l != "", alt_l)
    branding, content = (F.concat(F.lit(head), F.coalesce(label, F.lit(empty))) for head, empty in CLASSIC_LABELS[variant])
    img_ctx = F.when(brand, branding).when(~ui, content)

    def item(pass_no, sub, url, kind, ctx):
        return F.struct(F.lit(pass_no).alias("pass_no"), sub.alias("sub"), url.alias("media_url"),
                        F.lit(kind).alias("type"), ctx.alias("context"))

    img = F.when((tag == "img") & src.isNotNull() & img_ctx.isNotNull(),
                 F.array(item(0, F.lit(0), src, "image", img_ctx)))
    vid = F.when(tag.isin("video", "source") & (F.coalesce(_attr("src"), F.lit("")) != ""),
                 F.array(item(1, F.lit(0), _attr("src"), "video", F.lit("Video content"))))
    bgs = F.when(tag.isin("div", "section", "header") & _attr("style").isNotNull(),
                 F.transform(F.regexp_extract_all(_attr("style"), F.lit(BACKGROUND_URL_REGEX), 1),
                             lambda u, i: item(2, i, u, "image", F.lit("Background image"))))
    items = F.coalesce(img, vid, bgs)
    rows = elements.filter(tag.isin("img", "video", "source", "div", "section", "header")).select(
        "page_id", "node_id", F.explode(items).alias("m"))
    return rows.select("page_id", F.col("m.pass_no").alias("pass_no"), "node_id", F.col("m.sub").alias("sub"),
                       F.col("m.media_url").alias("media_url"), F.col("m.type").alias("type"),
                       F.col("m.context").alias("context"))


# -------------------------------------------------------- context priority
def _ctx_tier(ctx: Column, tiers) -> Column:
    c = F.lower(ctx)
    expr = None
    for words, score in tiers:
        cond = _contains_any(c, words)
        expr = F.when(cond, score) if expr is None else expr.when(cond, score)
    return expr.otherwise(CONTEXT_DEFAULT_PRIORITY)


def _square(w: Column, h: Column) -> Column:
    ratio = w.cast("double") / h.cast("double")
    return (w > 0) & (h > 0) & (ratio >= SQUARE_RATIO[0]) & (ratio <= SQUARE_RATIO[1])


def priority_classic(context, media_type, width, height, require_min_width: bool = True) -> Column:
    """logo/brand 100, team/founder/leader 80, office/location/building 60,
    product/service 40, else 10; +20 for a square-ish image (the API also
    requires width >= 100; the app variant does not)."""
    base = _ctx_tier(F.col(context), CONTEXT_TIERS_CLASSIC)
    w, h = F.col(width), F.col(height)
    sq = (F.col(media_type) == "image") & _square(w, h)
    if require_min_width:
        sq = sq & (w >= MIN_IMAGE_SIDE_PX)
    return base + F.when(sq, 20).otherwise(0)


def priority_root_svc(context, width, height) -> Column:
    """100/80/60/40 tiers (no "building"), +20 square, +10 if either side
    >= 1000 px, uncapped."""
    base = _ctx_tier(F.col(context), CONTEXT_TIERS_ROOT_SVC)
    w, h = F.col(width), F.col(height)
    has = (w > 0) & (h > 0)
    return (base + F.when(has & _square(w, h), 20).otherwise(0)
            + F.when(has & ((w >= LARGE_SIDE_PX) | (h >= LARGE_SIDE_PX)), 10).otherwise(0))


def priority_service(context, width, height) -> Column:
    """80/60/40/30/10 tiers, +15 square and +5 for >= 1000 px, each step
    capped at 100."""
    base = _ctx_tier(F.col(context), CONTEXT_TIERS_SERVICE)
    w, h = F.col(width), F.col(height)
    has = (w > 0) & (h > 0)
    p1 = F.when(has & _square(w, h), F.least(base + 15, F.lit(100))).otherwise(base)
    return F.when(has & ((w >= LARGE_SIDE_PX) | (h >= LARGE_SIDE_PX)), F.least(p1 + 5, F.lit(100))).otherwise(p1)


def media_kind_from_name(filename) -> Column:
    """Lower-cased extension; video if in the video set, else image."""
    ext = F.element_at(F.split(F.lower(F.col(filename)), r"\."), -1)
    return F.when(ext.isin(*VIDEO_FORMATS), "video").otherwise("image")


def admit_media(content_type, size) -> Column:
    """MIME in the allow-list (substring test) and size <= 10 MB."""
    from ..functions.constants import ALLOWED_MIME
    ct = F.lower(F.coalesce(F.col(content_type), F.lit("")))
    ok = None
    for m in ALLOWED_MIME:
        c = ct.contains(m)
        ok = c if ok is None else (ok | c)
    return ok & (F.col(size) <= 10 * 1024 * 1024)


__all__ = [
    "split_media", "media_summary", "hybrid_media", "hybrid_summary", "simple_media", "svc_media",
    "classic_media", "priority_classic", "priority_root_svc", "priority_service",
    "media_kind_from_name", "admit_media", "lazy_src", "CLASS_RANK", "sql_array",
]
