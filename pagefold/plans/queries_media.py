"""Media queries on the gallery stand-in pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.media import (
    hybrid_media, hybrid_summary, media_summary, pages_of, simple_media, split_media, svc_media,
)
from ..operators.paging import all_pages, split_page
from ..operators.thumbs import PLACEHOLDER_URL
from ..session import materialize_elements
from ..sources.html import parse_pages
from ..sources.standin import gallery_pages
from .media_pages import media_endpoint
from .registry import register


def gallery_elements(spark, sf_dir):
    """The parsed galleries, stored so that a query's branches share one parse."""
    return materialize_elements(parse_pages(gallery_pages(spark, sf_dir)), "gallery-elements")


# DuckDB: the expected media of every gallery item, from part columns.
GALLERY_SQL = """
WITH g AS (
  SELECT p_partkey AS pk, 2000000000 + p_partkey // 40 AS page_id, CAST(p_partkey % 10 AS INTEGER) AS kind,
         p_name, p_brand, p_type, p_size,
         'https://media' || CAST(p_partkey // 40 AS VARCHAR) || '.example.com' AS host
  FROM part
), items AS (
  SELECT page_id, pk, kind, p_name, p_brand, p_type, p_size, host,
    CASE kind WHEN 0 THEN host || '/img/p' || pk || '.jpg'
              WHEN 1 THEN host || '/img/p' || pk || '.png'
              WHEN 2 THEN host || '/gallery/icons/button-' || pk || '.svg'
              WHEN 3 THEN 'https://www.youtube.com/embed/v' || lpad(CAST(pk AS VARCHAR), 10, '0')
              WHEN 4 THEN host || '/media/p' || pk || '.mp4'
              WHEN 5 THEN host || '/docs/spec-' || pk || '.pdf'
              WHEN 6 THEN host || '/fav/' || pk || '.ico'
              WHEN 7 THEN host || '/img/cart-' || pk || '.gif'
              WHEN 8 THEN host || '/maps/' || pk
              ELSE host || '/audio/p' || pk || '.mp3' END AS media_url,
    CASE kind WHEN 0 THEN p_name WHEN 1 THEN p_brand || ' logo' WHEN 7 THEN 'Team ' || p_size ELSE '' END AS alt,
    CASE kind WHEN 1 THEN 'logo' WHEN 2 THEN 'header-img' ELSE '' END AS cls
  FROM g
), split AS (
  SELECT page_id, pk, media_url, alt,
    CASE WHEN kind IN (0, 1, 2, 7) THEN 'image' WHEN kind = 3 THEN 'iframe' WHEN kind = 4 THEN 'video'
         WHEN kind = 5 THEN 'document' WHEN kind = 6 THEN 'icon' END AS type,
    CASE WHEN kind IN (0, 1, 2, 7) THEN
           CASE WHEN regexp_matches(lower(alt), 'logo|brand|company') THEN 100
                WHEN regexp_matches(lower(alt), 'team|founder|ceo') THEN 80
                WHEN regexp_matches(cls, 'logo|brand|header') THEN 90
                WHEN NOT regexp_matches(lower(media_url), 'icon|button|arrow|cart') THEN 50
                ELSE 10 END
         WHEN kind IN (3, 4) THEN 60 WHEN kind = 5 THEN 70 ELSE 85 END AS priority,
    CASE WHEN kind IN (0, 1, 2, 7) THEN coalesce(nullif(lower(alt), ''), 'Image')
         WHEN kind = 3 THEN p_type WHEN kind = 4 THEN 'Video'
         WHEN kind = 5 THEN trim(p_type) ELSE 'Favicon/Icon' END AS context,
    CASE WHEN kind IN (0, 1, 2, 7) THEN 0 WHEN kind IN (3, 4) THEN 1 WHEN kind = 5 THEN 2 ELSE 3 END AS class_rank,
    kind
  FROM items WHERE kind <= 7
)
"""


@register("m6_m7_split_media", oracle=GALLERY_SQL + """
SELECT page_id, substr(md5(media_url), 1, 12) AS id, media_url, type, priority, context FROM split
""")
def m6_m7_split_media(spark, sf_dir):
    """The split variant's flat, scored media list."""
    m = split_media(gallery_elements(spark, sf_dir))
    return m.select("page_id", "id", "media_url", "type", "priority", "context")


@register("g1_split_media_summary", oracle=GALLERY_SQL + """
SELECT page_id, count(*) AS total_assets, CAST(count_if(type = 'image') AS BIGINT) AS images_count,
       CAST(count_if(type IN ('video', 'iframe')) AS BIGINT) AS videos_count,
       CAST(count_if(type = 'document') AS BIGINT) AS documents_count,
       CAST(count_if(type = 'icon') AS BIGINT) AS icons_count
FROM split GROUP BY page_id
""")
def g1_split_media_summary(spark, sf_dir):
    """G1: per-page media counts over the full split list."""
    return media_summary(split_media(gallery_elements(spark, sf_dir)))


@register("g1_w9_pages_without_media", oracle=GALLERY_SQL + """
, pages AS (
  SELECT DISTINCT page_id FROM split
  UNION ALL SELECT DISTINCT page_id + 1000000000 FROM split
)
SELECT p.page_id, count(s.type) AS total_assets, CAST(coalesce(count_if(s.type = 'image'), 0) AS BIGINT) AS images_count,
       count(s.type) AS total_count, count(s.type) > 20 AS has_more, least(20, count(s.type)) AS items_on_page
FROM pages p LEFT JOIN split s USING (page_id) GROUP BY p.page_id
""")
def g1_w9_pages_without_media(spark, sf_dir):
    """G1, W9 and Q-B answer for every page: each gallery has a second page of
    prose only, which has zero totals and an empty list."""
    galleries = gallery_pages(spark, sf_dir)
    prose = galleries.select((F.col("page_id") + 1_000_000_000).alias("page_id"), F.concat("url", F.lit("?prose")).alias("url"),
                             F.lit("<html><body><p>No media here</p></body></html>").alias("html"))
    elements = materialize_elements(parse_pages(galleries.unionByName(prose)), "gallery-elements")
    media, pages = split_media(elements), pages_of(elements)
    summary = media_summary(media, pages).select("page_id", "total_assets", "images_count")
    _, meta = split_page(media, None, 20, pages=pages)
    listed = media_endpoint(elements, None, 20).select("page_id", F.size("media_assets").cast("long").alias("items_on_page"))
    return (summary.join(meta.select("page_id", "total_count", "has_more"), "page_id").join(listed, "page_id"))


@register("w12_all_media_pages", oracle=GALLERY_SQL + """
SELECT page_id, CAST(pos AS INTEGER) AS pos, CAST((pos - 1) // 20 AS INTEGER) AS page_no, media_url, priority
FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, class_rank, pk) AS pos FROM split)
""")
def w12_all_media_pages(spark, sf_dir):
    """W3+W12: stable priority order and every 20-item result page at once,
    numbered with the skew-safe position_within."""
    pages = all_pages(split_media(gallery_elements(spark, sf_dir)), 20)
    return pages.select("page_id", "pos", "page_no", "media_url", "priority")


@register("w5_w9_media_page_at_cursor", oracle=GALLERY_SQL + """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, class_rank, pk) AS pos FROM split),
totals AS (SELECT page_id, count(*) AS total_count FROM split GROUP BY page_id),
cur AS (SELECT page_id, count(*) AS current_page_count,
               CAST(count_if(type = 'image') AS BIGINT) AS images_on_page
        FROM ranked WHERE pos > 20 AND pos <= 40 GROUP BY page_id)
SELECT t.page_id, t.total_count, 20 AS current_page_start, least(40, t.total_count) AS current_page_end,
       least(40, t.total_count) < t.total_count AS has_more,
       CASE WHEN least(40, t.total_count) < t.total_count THEN to_base64(encode('media:' || least(40, t.total_count))) END AS next_cursor,
       coalesce(c.current_page_count, 0) AS current_page_count, coalesce(c.images_on_page, 0) AS images_on_page
FROM totals t LEFT JOIN cur c USING (page_id)
""")
def w5_w9_media_page_at_cursor(spark, sf_dir):
    """The page after cursor base64("media:20") with limit 20,
    its metadata, and the post-slice media_type=image filter."""
    media = split_media(gallery_elements(spark, sf_dir))
    items, meta = split_page(media, "bWVkaWE6MjA=", 20)
    images, _ = split_page(media, "bWVkaWE6MjA=", 20, media_type="image")
    n = items.groupBy("page_id").agg(F.count("*").alias("current_page_count"))
    ni = images.groupBy("page_id").agg(F.count("*").alias("images_on_page"))
    return (meta.join(n, "page_id", "left").join(ni, "page_id", "left")
            .fillna(0, ["current_page_count", "images_on_page"]))


@register("t8_split_video_thumbnails", oracle=GALLERY_SQL + """
SELECT page_id, media_url,
  CASE WHEN kind = 3 THEN 'https://img.youtube.com/vi/v' || lpad(CAST(pk AS VARCHAR), 10, '0') || '/maxresdefault.jpg'
       WHEN pk % 20 = 4 THEN '""" + PLACEHOLDER_URL + """'
       ELSE 'https://media' || CAST(pk // 40 AS VARCHAR) || '.example.com/gallery/index.html/media/p' || pk || '.jpg' END AS thumbnail_url,
  CASE WHEN kind = 3 THEN 'platform' WHEN pk % 20 = 4 THEN 'placeholder' ELSE 'poster' END AS thumbnail_type,
  CASE WHEN kind = 3 THEN 'youtube' WHEN pk % 20 = 4 THEN 'generated' ELSE 'existing_poster' END AS thumbnail_source,
  CASE WHEN kind = 4 AND pk % 20 = 4 THEN true END AS is_placeholder_thumbnail
FROM split WHERE kind IN (3, 4)
""")
def t8_split_video_thumbnails(spark, sf_dir):
    """Thumbnail ladder on each split video item."""
    m = split_media(gallery_elements(spark, sf_dir)).filter(F.col("type").isin("video", "iframe"))
    return m.select("page_id", "media_url", "thumbnail_url", "thumbnail_type", "thumbnail_source",
                    "is_placeholder_thumbnail")


@register("m8_v4_simple_media", oracle=GALLERY_SQL + """
, imgs AS (SELECT page_id, 'images' AS kind, row_number() OVER (PARTITION BY page_id ORDER BY pk) AS ord, media_url
           FROM split WHERE type = 'image'),
vids AS (SELECT page_id, 'videos' AS kind, row_number() OVER (PARTITION BY page_id ORDER BY pk) AS ord, media_url
           FROM split WHERE type IN ('video', 'iframe'))
SELECT page_id, kind, CAST(ord AS INTEGER) AS ord, media_url FROM imgs WHERE ord <= 20
UNION ALL SELECT page_id, kind, CAST(ord AS INTEGER) AS ord, media_url FROM vids WHERE ord <= 10
""")
def m8_v4_simple_media(spark, sf_dir):
    """First 20 image urls and first 10 video urls per page."""
    return simple_media(gallery_elements(spark, sf_dir))


@register("m9_svc_media_context", oracle=GALLERY_SQL + """
SELECT page_id, media_url, CASE WHEN kind IN (1, 2, 7) THEN 'image' ELSE 'video' END AS type,
  CASE kind WHEN 1 THEN p_brand || ' logo' WHEN 7 THEN 'Team ' || p_size WHEN 2 THEN left(p_name, 100)
            WHEN 3 THEN p_type ELSE 'Video' END AS context
FROM items WHERE kind IN (1, 2, 3, 4, 7, 8)
""")
def m9_svc_media_context(spark, sf_dir):
    """Service media list with alt -> title -> parent text -> default."""
    return svc_media(gallery_elements(spark, sf_dir)).select("page_id", "media_url", "type", "context")


@register("m1_m5_hybrid_media", oracle=GALLERY_SQL + """
SELECT page_id, media_url,
  CASE WHEN kind IN (0, 1, 2, 7) THEN 'images' WHEN kind IN (3, 4, 8) THEN 'videos' WHEN kind = 9 THEN 'audio'
       WHEN kind = 5 THEN 'documents' ELSE 'icons' END AS kind,
  CASE WHEN kind IN (0, 1, 2, 7) THEN
       CASE WHEN regexp_matches(lower(alt || ' ' || cls), 'logo|brand|company') THEN 'high' ELSE 'medium' END END AS priority,
  CASE WHEN kind = 5 THEN 'spec-' || pk || '.pdf' END AS filename,
  CASE kind WHEN 3 THEN 'iframe' WHEN 4 THEN 'video' WHEN 8 THEN 'iframe' END AS type
FROM items
""")
def m1_m5_hybrid_media(spark, sf_dir):
    """The hybrid variant's images, videos, audio, documents, icons."""
    m = hybrid_media(gallery_elements(spark, sf_dir))
    return m.select("page_id", "media_url", "kind", "priority", "filename", "type")


@register("g2_hybrid_media_summary", oracle=GALLERY_SQL + """
SELECT page_id, count(*) AS total_assets, CAST(count_if(kind IN (0, 1, 2, 7)) AS BIGINT) AS images_count,
       CAST(count_if(kind IN (3, 4, 8)) AS BIGINT) AS videos_count,
       CAST(count_if(kind = 5) AS BIGINT) AS documents_count,
       CAST(count_if(kind = 6) AS BIGINT) AS icons_count
FROM items GROUP BY page_id
""")
def g2_hybrid_media_summary(spark, sf_dir):
    """Hybrid media_summary (audio counted in the total only)."""
    return hybrid_summary(hybrid_media(gallery_elements(spark, sf_dir)))


@register("qb_media_endpoint", oracle=GALLERY_SQL + """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, class_rank, pk) AS pos FROM split)
SELECT page_id, CAST(count_if(pos <= 20) AS BIGINT) AS current_page_count,
       arg_min(media_url, pos) AS first_url, count(*) AS total_assets,
       count(*) > 20 AS has_more,
       CASE WHEN count(*) > 20 THEN to_base64(encode('media:20')) END AS next_cursor,
       CAST(least(20, count(*)) AS INTEGER) AS current_page_end
FROM ranked GROUP BY page_id
""")
def qb_media_endpoint(spark, sf_dir):
    """Q-B: first page (limit 20) of every gallery page's media endpoint
    envelope — nested items, summary and pagination."""
    from .media_pages import media_endpoint
    env = media_endpoint(gallery_elements(spark, sf_dir), None, 20)
    return env.select("page_id", F.col("media_summary.current_page_count").alias("current_page_count"),
                      F.col("media_assets")[0]["media_url"].alias("first_url"),
                      F.col("media_summary.total_assets").alias("total_assets"),
                      F.col("pagination.has_more").alias("has_more"),
                      F.col("pagination.next_cursor").alias("next_cursor"),
                      F.col("pagination.current_page_end").cast("int").alias("current_page_end"))
