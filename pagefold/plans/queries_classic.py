"""Classic-variant queries: HTML/LLM media with context priority (M10-M16),
root pagination and cursors (W6, W8, W10), and the combined profile+media
flow with a pluggable model (Q-D, G3/L7)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators.json_media import ai_media, first_seen
from ..operators.llm import (
    build_prompt, completeness_error, enrich, lenient_fallback_model, stub_profile_model,
)
from ..operators.media import classic_media, priority_classic
from ..operators.paging import decode_json_cursor, decode_json_cursor_value, page_meta_root, position_within, slice_of
from ..operators.topk import first_k
from ..session import materialize_elements, table
from ..sources.html import parse_pages
from ..sources.standin import company_site, gallery_pages
from .classic import classic_combined, combine
from .registry import register


@register("m10_m16_classic_media", oracle="""
WITH g AS (
  SELECT p_partkey AS pk, 2000000000 + p_partkey // 40 AS page_id, CAST(p_partkey % 10 AS INTEGER) AS kind,
         p_name, p_brand, p_size FROM part
), m AS (
  SELECT page_id, pk, 0 AS pass_no, '/img/p' || pk || '.jpg' AS media_url, lower(p_name) AS alt FROM g WHERE kind = 0
  UNION ALL SELECT page_id, pk, 0, '/img/p' || pk || '.png', lower(p_brand || ' logo') FROM g WHERE kind = 1
  UNION ALL SELECT page_id, pk, 0, 'icons/button-' || pk || '.svg', '' FROM g WHERE kind = 2
  UNION ALL SELECT page_id, pk, 0, '/img/cart-' || pk || '.gif', lower('Team ' || p_size) FROM g WHERE kind = 7
  UNION ALL SELECT page_id, pk, 1, '/media/p' || pk || '.mp4', NULL FROM g WHERE kind = 4
  UNION ALL SELECT page_id, pk, 2, '/bg/p' || pk || '.png', NULL FROM g WHERE kind = 9
), c AS (
  SELECT page_id, pk, pass_no, media_url, CASE WHEN pass_no = 1 THEN 'video' ELSE 'image' END AS type,
    CASE WHEN pass_no = 1 THEN 'Video content' WHEN pass_no = 2 THEN 'Background image'
         WHEN regexp_matches(alt, 'logo|brand|company|team|about|founder|staff|office')
           OR regexp_matches(lower(media_url), 'logo|brand|company|team|about|founder|staff|office')
           THEN 'Company image: ' || coalesce(nullif(alt, ''), 'Branding content')
         WHEN NOT regexp_matches(lower(media_url), 'icon|button|arrow|cart|search|menu')
           THEN 'Content image: ' || coalesce(nullif(alt, ''), 'Page content') END AS context
  FROM m
), p AS (
  SELECT *, CASE WHEN regexp_matches(lower(context), 'logo|brand') THEN 100
                 WHEN regexp_matches(lower(context), 'team|founder|leader') THEN 80
                 WHEN regexp_matches(lower(context), 'office|location|building') THEN 60
                 WHEN regexp_matches(lower(context), 'product|service') THEN 40 ELSE 10 END AS priority
  FROM c WHERE context IS NOT NULL
)
SELECT page_id, media_url, type, context, priority,
       CAST(row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, pass_no, pk) AS INTEGER) AS rank
FROM p
""")
def m10_m16_classic_media(spark, sf_dir):
    """Classic HTML media (branding filter, video
    and source tags, CSS backgrounds), first-seen dedupe, context priority,
    stable priority order."""
    el = materialize_elements(parse_pages(gallery_pages(spark, sf_dir)), "gallery-elements")
    html = classic_media(el)
    none = html.limit(0).select("page_id", F.lit(0).alias("ord"), "media_url", "type", "context")
    m = first_seen(html, none)
    m = m.withColumn("w", F.lit(None).cast("int")).withColumn("h", F.lit(None).cast("int"))
    m = m.withColumn("priority", priority_classic("context", "type", "w", "h"))
    m = position_within(m, "page_id", [F.col("priority").desc(), F.col("o")],
                        [-F.col("priority"), "o.src", "o.pass_no", slice_of("o.node_id")], "rank")
    return m.select("page_id", "media_url", "type", "context", "priority", "rank")


_CLASSIC_MEDIA_CTE = """
WITH g AS (
  SELECT p_partkey AS pk, 2000000000 + p_partkey // 40 AS page_id, CAST(p_partkey % 10 AS INTEGER) AS kind,
         p_name, p_brand, p_size FROM part
), m AS (
  SELECT page_id, pk, 0 AS pass_no, '/img/p' || pk || '.jpg' AS media_url, lower(p_name) AS alt FROM g WHERE kind = 0
  UNION ALL SELECT page_id, pk, 0, '/img/p' || pk || '.png', lower(p_brand || ' logo') FROM g WHERE kind = 1
  UNION ALL SELECT page_id, pk, 0, 'icons/button-' || pk || '.svg', '' FROM g WHERE kind = 2
  UNION ALL SELECT page_id, pk, 0, '/img/cart-' || pk || '.gif', lower('Team ' || p_size) FROM g WHERE kind = 7
  UNION ALL SELECT page_id, pk, 1, '/media/p' || pk || '.mp4', NULL FROM g WHERE kind = 4
  UNION ALL SELECT page_id, pk, 2, '/bg/p' || pk || '.png', NULL FROM g WHERE kind = 9
), c AS (
  SELECT page_id, pk, pass_no, media_url, CASE WHEN pass_no = 1 THEN 'video' ELSE 'image' END AS type,
    CASE WHEN pass_no = 1 THEN 'Video content' WHEN pass_no = 2 THEN 'Background image'
         WHEN regexp_matches(alt, 'logo|brand|company|team|about|founder|staff|office')
           OR regexp_matches(lower(media_url), 'logo|brand|company|team|about|founder|staff|office')
           THEN 'Company image: ' || coalesce(nullif(alt, ''), 'Branding content')
         WHEN NOT regexp_matches(lower(media_url), 'icon|button|arrow|cart|search|menu')
           THEN 'Content image: ' || coalesce(nullif(alt, ''), 'Page content') END AS context
  FROM m
), p AS (
  SELECT *, CASE WHEN regexp_matches(lower(context), 'logo|brand') THEN 100
                 WHEN regexp_matches(lower(context), 'team|founder|leader') THEN 80
                 WHEN regexp_matches(lower(context), 'office|location|building') THEN 60
                 WHEN regexp_matches(lower(context), 'product|service') THEN 40 ELSE 10 END AS priority
  FROM c WHERE context IS NOT NULL
)
"""


@register("g4_classic_media_counts", oracle=_CLASSIC_MEDIA_CTE + """
SELECT page_id, CAST(count_if(type = 'image') AS BIGINT) AS image_count,
       CAST(count_if(type = 'video') AS BIGINT) AS video_count FROM p GROUP BY page_id
""")
def g4_classic_media_counts(spark, sf_dir):
    """Image and video counts per page over the classic media list."""
    m = classic_media(materialize_elements(parse_pages(gallery_pages(spark, sf_dir)), "gallery-elements"))
    return m.groupBy("page_id").agg(F.count_if(F.col("type") == "image").alias("image_count"),
                                    F.count_if(F.col("type") == "video").alias("video_count"))


def llm_results(spark, sf_dir):
    """Stand-in LLM JSON results, one per order: a company object with a
    logo, a team photo list (one entry without extension), an optional video
    and a nested media object."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    company = F.struct(
        F.concat(F.lit("C"), F.col("o_custkey")).alias("name"),
        F.concat(F.lit("https://img.example.com/logo"), k, F.lit(".png")).alias("logo"),
        F.array(F.struct(F.concat(F.lit("https://img.example.com/t"), k, F.lit(".jpg")).alias("photo")),
                F.struct(F.concat(F.lit("no-extension-"), k).alias("photo"))).alias("team"),
        F.when(k % 3 == 0, F.concat(F.lit("https://vid.example.com/v"), k, F.lit(".mp4"))).alias("video"),
        F.struct(F.concat(F.lit("https://vid.example.com/c"), k, F.lit(".webm")).alias("clip")).alias("media"))
    doc = F.struct(F.struct(company.alias("company"),
                            F.concat(F.lit("see https://x.example.com/n"), k, F.lit(".gif")).alias("notes"))
                   .alias("content"))
    return o.select("o_orderkey", F.to_json(doc).alias("result_json"))


@register("m13_llm_json_media", oracle="""
WITH o AS (SELECT o_orderkey AS k FROM orders),
m AS (
  SELECT k, 0 AS ord, 'https://img.example.com/logo' || k || '.png' AS media_url, 'image' AS type, 'AI found: company.logo' AS context FROM o
  UNION ALL SELECT k, 1, 'https://img.example.com/t' || k || '.jpg', 'image', 'AI found: company.team[0].photo' FROM o
  UNION ALL SELECT k, 2, 'https://vid.example.com/v' || k || '.mp4', 'video', 'AI found: company.video' FROM o WHERE k % 3 = 0
  UNION ALL SELECT k, CASE WHEN k % 3 = 0 THEN 3 ELSE 2 END, 'https://vid.example.com/c' || k || '.webm', 'video',
                   'AI found: company.media.clip' FROM o
)
SELECT k AS o_orderkey, CAST(ord AS INTEGER) AS ord, media_url, type, context FROM m
""")
def m13_llm_json_media(spark, sf_dir):
    """Media keys with media-extension string values found by walking
    each LLM JSON result (the ``content`` object when present)."""
    return ai_media(llm_results(spark, sf_dir), "result_json", ["o_orderkey"], mode="api").select(
        "o_orderkey", "ord", "media_url", "type", "context")


_START, _LIMIT = 2, 3
_CURSOR = "eyJvZmZzZXQiOiAyfQ=="   # base64('{"offset": 2}')


@register("w6_w8_root_pagination", oracle=f"""
WITH r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos FROM orders),
t AS (SELECT o_custkey, count(*) AS total_count,
             CAST(count_if(pos > {_START} AND pos <= {_START + _LIMIT}) AS BIGINT) AS page_items FROM r GROUP BY o_custkey)
SELECT o_custkey, total_count, greatest(0, total_count - {_START + _LIMIT}) AS remaining_count,
       total_count - {_START + _LIMIT} > 0 AS has_more,
       CASE WHEN total_count - {_START + _LIMIT} > 0 THEN to_base64(encode('{{"offset": {_START + _LIMIT}}}')) END AS next_cursor,
       to_base64(encode('{{"offset": {max(0, _START - _LIMIT)}}}')) AS previous_cursor,
       page_items
FROM t
""")
def w6_w8_root_pagination(spark, sf_dir):
    """Root-style offset pagination of each customer's orders with
    a JSON cursor (offset 2, limit 3): page slice, remaining count, next and
    previous cursors."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    start, _valid = decode_json_cursor_value(_CURSOR)
    page = first_k(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], start + _LIMIT, "pos")
    items = page.filter(F.col("pos") > start).groupBy("o_custkey").agg(F.count("*").alias("page_items"))
    totals = o.groupBy("o_custkey").agg(F.count("*").alias("total_count"))
    meta = page_meta_root(F.col("total_count"), F.lit(start), _LIMIT)
    return (totals.join(items, "o_custkey", "left")
            .select("o_custkey", *[v.alias(k) for k, v in meta.items()],
                    F.coalesce("page_items", F.lit(0)).alias("page_items")))


@register("w10_cursor_decode", oracle="""
WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id,
  CASE WHEN k % 4 IN (0, 1) THEN CAST(k AS INTEGER) ELSE 0 END AS "offset",
  k % 4 <> 2 AS is_valid
FROM e
""")
def w10_cursor_decode(spark, sf_dir):
    """Decode a JSON cursor column to (offset, is_valid): valid
    cursors, cursors with extra keys, undecodable text and absent cursors."""
    e = table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    v = F.col("k") % 4
    enc = F.base64(F.encode(F.format_string('{"offset": %d}', F.col("k")), "UTF-8"))
    enc2 = F.base64(F.encode(F.format_string('{"offset": %d, "x": 1}', F.col("k")), "UTF-8"))
    cursor = (F.when(v == 0, enc).when(v == 1, enc2).when(v == 2, F.lit("invalid-cursor")))
    off, valid = decode_json_cursor(cursor)
    return e.select("event_id", off.cast("int").alias("offset"), valid.alias("is_valid"))


def _qd_sql() -> str:
    from ..functions.constants import CLASSIC_LOCATION_PATTERNS
    from .queries_company import SITE_SQL
    loc = " ".join(f"WHEN regexp_matches(about_us, '(?i){p}') THEN trim(regexp_extract(about_us, '(?i){p}', 1))"
                   for p in CLASSIC_LOCATION_PATTERNS)
    return SITE_SQL + f"""
, sent AS (
  SELECT k, page_id, url, is_home,
         list_filter(list_transform(string_split(replace(page_text, '!', '.'), '.'), lambda x: trim(x)),
                     lambda x: x <> '') AS sentences
  FROM crawl
), ab AS (
  SELECT k, page_id, url, is_home, coalesce(list_filter(sentences, lambda x: contains(lower(x), 'based in')
                                                   OR contains(lower(x), 'founded'))[1], sentences[1]) || '.' AS about_us
  FROM sent
)
SELECT page_id, url AS url_scraped, true AS success, CAST(NULL AS VARCHAR) AS error, about_us,
       coalesce(CASE {loc} END, 'No location found') AS locations,
       CAST(CASE WHEN is_home THEN 2 + k % 2 ELSE 0 END AS BIGINT) AS media_count
FROM ab
"""


@register("qd_classic_combined", oracle=_qd_sql())
def qd_classic_combined(spark, sf_dir):
    """Q-D with the deterministic stand-in model: classic profile via the
    About fallback ladder and the model, classic media from HTML and the
    LLM result, combined per page (J5)."""
    el = materialize_elements(parse_pages(company_site(spark, sf_dir)), "site-elements")
    profile, media = classic_combined(el, stub_profile_model, lenient_fallback_model)
    c = combine(profile, media)
    return c.select("page_id", "url_scraped", "success", "error",
                    F.col("profile.about_us").alias("about_us"), F.col("profile.locations").alias("locations"),
                    "media_count")


PROMPTS = {
    "detailed": "Describe the company profile in detail as JSON.",
    "concise": "Give a concise company profile as JSON.",
}


def stub_batch_model(prompt: str) -> dict:
    """Stand-in batch scraper answer: profile sections and media found in
    the analysed content (a concise prompt omits the Noteworthy section)."""
    body = prompt.split("Here is the content to analyze:\n", 1)[-1]
    prof = {"About Us (including locations)": body[:80], "Our Culture": "", "Our Team": ""}
    if "concise" not in prompt:
        prof["Noteworthy & Differentiated"] = ""
    media = [{"url": "https://cdn.example.com/x.png", "type": "image"}] if "report" in body else []
    return {"completion": json.dumps({"profile": prof, "media": media})}


def _g3_sql() -> str:
    from .queries_company import SITE_SQL
    return SITE_SQL + """
, batch AS (SELECT * FROM crawl ORDER BY url LIMIT 20),
n AS (SELECT count(*) AS n, avg(CASE WHEN contains(page_text, 'report') THEN 1.0 ELSE 0.0 END) AS media FROM batch)
SELECT 'detailed' AS prompt_name, CAST(n / 20 AS DOUBLE) AS success_rate, CAST(media AS DOUBLE) AS avg_media_count,
       CAST(0 AS BIGINT) AS n_errors FROM n
UNION ALL
SELECT 'concise', CAST(0 AS DOUBLE), CAST(media AS DOUBLE), CAST(n AS BIGINT) FROM n
"""


@register("g3_l7_prompt_comparison", oracle=_g3_sql())
def g3_l7_prompt_comparison(spark, sf_dir, batch_size: int = 20):
    """G3/L7/X8/L6 with the deterministic stand-in model: each prompt variant
    over the first ``batch_size`` urls, completeness errors, success rate
    (divided by batch_size, Q12) and mean media count."""
    el = materialize_elements(parse_pages(company_site(spark, sf_dir)), "site-elements")
    from ..operators.links import page_texts
    pages = page_texts(el).select(F.col("about_url").alias("url"), F.col("about_text").alias("text"))
    batch = pages.orderBy("url").limit(batch_size)          # the batch is the feature
    prompts = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("text")) for k, v in PROMPTS.items()])
    runs = batch.select("url", "text", F.explode(prompts).alias("p"))
    runs = runs.select("url", F.col("p.name").alias("prompt_name"),
                       build_prompt(F.col("p.text"), F.col("text")).alias("prompt"))
    out = enrich(runs, stub_batch_model)
    out = out.withColumn("error", F.coalesce("error", completeness_error("result")))
    n_media = F.coalesce(F.size(F.try_variant_get("result", "$.media", "array<variant>")), F.lit(0))
    return out.groupBy("prompt_name").agg(
        (F.count_if(F.col("error").isNull()) / F.lit(batch_size)).alias("success_rate"),
        F.avg(n_media).alias("avg_media_count"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"))
