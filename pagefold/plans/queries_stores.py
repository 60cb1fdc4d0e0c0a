"""Tables that a run leaves behind and the next takes up: model answers, the
bucketed media store and cache; the service's media request; request limits
(L2, L6, L8, X9, X10, S7, S10, S12, M9, M10 app, M17, W9s, V6)."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import functions as F

from ..functions.constants import (
    MAX_URL_LENGTH, NO_LOCATION, NOT_AVAILABLE, PROMPT_TEMPLATE, REQUEST_LIMITS, REQUEST_MODELS,
)
from ..operators import cache
from ..operators.llm import build_prompt, classic_profile, failure_profile, meaningful_profile
from ..operators.media import classic_media, priority_classic, svc_media
from ..operators.model_calls import enrich_stored
from ..operators.quality import page_meta_violations, scrape_request_violations
from ..session import ensure_checkpoint_dir, table
from ..sources.buckets import BucketTable, insert_absent
from ..sources.sinks import delete_keys, store_media
from .queries_classic import _CLASSIC_MEDIA_CTE
from .queries_media import GALLERY_SQL, gallery_elements
from .queries_service import _CACHE_SQL, _STORE_SQL, CDN, NOW, cache_requests, cache_table, media_payloads
from .registry import register
from .service_media import service_media


def _fresh(spark, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


# ------------------------------------------------------------- model calls
SYSTEM = "Describe the speaker as JSON."
#: Longest prompt that is sent, in tokens of four characters.
SEND_TOKENS = 120
_HEAD, _TAIL = PROMPT_TEMPLATE.format(system=SYSTEM, user="\0").split("\0")


def _content(prompt: str) -> str:
    return prompt[len(_HEAD):len(prompt) - len(_TAIL)]


def unreliable_model(prompt: str) -> dict:
    """A model as the caller may have one: by the length of what it is given it is down, answers in prose or in JSON."""
    said = _content(prompt)
    if len(said) % 3 == 0:
        raise RuntimeError("model unavailable")
    return {"completion": "I cannot say." if len(said) % 3 == 1 else
            json.dumps({"content": {"profile": {"Our Team": said[:20]}}})}


def unreliable_fallback(prompt: str) -> dict:
    if len(_content(prompt)) % 2 == 0:
        raise RuntimeError("fallback unavailable")
    return {"completion": json.dumps({"content": {"profile": {"Our Culture": "Not stated"}}})}


@register("l6_l8_x10_stored_model_calls", oracle=f"""
WITH t AS (SELECT conv_id, turn, text, length(text) AS n, {len(_HEAD) + len(_TAIL)} + length(text) AS sent FROM conversations),
a AS (SELECT *, CASE WHEN text IS NULL OR sent // 4 > {SEND_TOKENS} THEN 'none' WHEN n % 3 = 2 THEN 'first'
                     WHEN n % 2 = 1 THEN 'second' ELSE 'failed' END AS who FROM t)
SELECT conv_id, turn, CASE who WHEN 'first' THEN 'default' WHEN 'none' THEN NULL ELSE 'fallback' END AS model,
       CASE who WHEN 'first' THEN left(text, 20) ELSE '{NOT_AVAILABLE}' END AS our_team,
       CASE who WHEN 'second' THEN 'Not stated' ELSE '{NOT_AVAILABLE}' END AS our_culture,
       '{NO_LOCATION}' AS locations, who IN ('first', 'second') AS success,
       CASE WHEN who = 'failed' THEN 'fallback unavailable' WHEN text IS NULL THEN 'No prompt'
            WHEN who = 'none' THEN 'Prompt exceeds {SEND_TOKENS} tokens' END AS error
FROM a
""")
def l6_l8_x10_stored_model_calls(spark, sf_dir):
    """Each distinct prompt asked once and its answer stored; calls that raise or answer
    in prose go to the fallback, those that fail there too give the failure row, prompts over the limit are not sent."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", build_prompt(F.lit(SYSTEM), F.col("text")).alias("prompt"))
    got = enrich_stored(said, unreliable_model, _fresh(spark, "answers"), unreliable_fallback, max_input_tokens=SEND_TOKENS)
    profile, failure = classic_profile("result"), failure_profile(F.col("error"))
    ok = F.coalesce(meaningful_profile("result"), F.lit(False))
    pick = lambda c: F.when(ok, profile[c]).otherwise(failure[c]).alias(c)
    return got.select("conv_id", "turn", "model", pick("our_team"), pick("our_culture"), pick("locations"),
                      ok.alias("success"), "error")


# ----------------------------------------------------------- bucketed tables
@register("s7_s10_bucketed_store", oracle=_STORE_SQL + """
SELECT key, media_type, size_bytes, content_type FROM s WHERE NOT (media_type = 'video' AND key LIKE '%.svg')
""")
def s7_s10_bucketed_store(spark, sf_dir):
    """The media store as a table of buckets: written with the images, then every medium that is not there yet
    is added, then the .svg videos are deleted; each step rewrites the buckets it touches."""
    media = store_media(media_payloads(spark, sf_dir), CDN, "2024-01-01")
    store = BucketTable(spark, _fresh(spark, "media-store"), ("key",), 32).create(media.filter("media_type = 'image'"))
    store.change(media, insert_absent(("key",)))
    store.change(store.read().filter((F.col("media_type") == "video") & F.col("key").endswith(".svg")).select("key"), delete_keys)
    return store.read().select("key", "media_type", "size_bytes", "content_type")


@register("s12_bucketed_cache", oracle=_CACHE_SQL + f"""
, w AS (SELECT url, type, page_id FROM r WHERE page_id % 3 = 0),
t AS (SELECT c.url, c.type, cpid AS page_id, '{{"page_id":' || cpid || '}}' AS data, CAST(expires_at AS BIGINT) AS expires_at
      FROM c ANTI JOIN w USING (url, type)
      UNION ALL SELECT url, type, page_id, 'written:' || page_id, CAST({NOW + 3600} AS BIGINT) FROM w)
SELECT url, type, data, expires_at FROM t WHERE NOT (type = 'media' AND page_id % 7 = 0)
""")
def s12_bucketed_cache(spark, sf_dir):
    """Upsert and delete on the cache as a table of buckets."""
    store = BucketTable(spark, _fresh(spark, "cache"), ("url", "type"), 16).create(cache_table(spark, sf_dir))
    requests = cache_requests(spark, sf_dir)
    store.change(requests.filter("page_id % 3 = 0").select(
        "url", "type", F.concat(F.lit("written:"), F.col("page_id")).alias("data"),
        F.lit(NOW + 3600).cast("long").alias("expires_at"), (F.lit(NOW) + F.col("page_id")).cast("long").alias("created_at")),
        cache.upsert)
    store.change(requests.filter("type = 'media' AND page_id % 7 = 0").select("url", "type"), cache.delete)
    return store.read().select("url", "type", "data", "expires_at")


# ------------------------------------------------------------- service media
@register("m9_s7_w9s_service_media", oracle=GALLERY_SQL + f"""
, f AS (
  SELECT page_id, pk, media_url, CASE WHEN kind IN (1, 2, 7) THEN 'image' ELSE 'video' END AS type,
    CASE kind WHEN 1 THEN p_brand || ' logo' WHEN 7 THEN 'Team ' || p_size WHEN 2 THEN left(p_name, 100)
              WHEN 3 THEN p_type ELSE 'Video' END AS context,
    length(media_url) AS n, length(media_url) * 20 AS w,
    CASE WHEN length(media_url) % 2 = 0 THEN length(media_url) * 20 ELSE 500 END AS h
  FROM items WHERE kind IN (1, 2, 3, 4, 7, 8) AND length(media_url) % 7 <> 0
), p AS (
  SELECT *, CASE WHEN regexp_matches(lower(context), 'logo|brand') THEN 100
                 WHEN regexp_matches(lower(context), 'team|founder|leader') THEN 80
                 WHEN regexp_matches(lower(context), 'office|location') THEN 60
                 WHEN regexp_matches(lower(context), 'product|service') THEN 40 ELSE 10 END
            + CASE WHEN w / h BETWEEN 0.8 AND 1.2 THEN 20 ELSE 0 END + CASE WHEN w >= 1000 OR h >= 1000 THEN 10 ELSE 0 END AS priority,
    regexp_extract(split_part(media_url, '/', -1), '^\\.*[^.].*(\\.[^.]*)$', 1) AS ext
  FROM f
), r AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, pk) AS pos, count(*) OVER (PARTITION BY page_id) AS total_count
  FROM p
)
SELECT page_id, CAST(pos AS INTEGER) AS pos,
       'https://{CDN}/' || type || 's/' || substr(sha256(media_url || media_url), 1, 32)
         || CASE WHEN ext <> '' THEN ext WHEN type = 'image' THEN '.jpg' ELSE '.mp4' END AS url,
       type, context, CAST(n AS INTEGER) AS size_bytes, CAST(priority AS INTEGER) AS priority, total_count,
       total_count > 10 AS has_more, CASE WHEN total_count > 10 THEN to_base64(encode('{{"offset": 10}}')) END AS next_cursor
FROM r WHERE pos > 4 AND pos <= 10
""")
def m9_s7_w9s_service_media(spark, sf_dir):
    """M9, W1, S7, M17, W3, W9s: the service's media page after cursor ``{"offset": 4}``, six items. Of each medium
    the fetched bytes are its URL; those whose URL's length is divisible by 7 could not be fetched."""
    elements = gallery_elements(spark, sf_dir)
    n = F.length("media_url")
    fetched = svc_media(elements).select("media_url").distinct().filter(n % 7 != 0).select(
        "media_url", F.encode("media_url", "UTF-8").alias("content"), (n * 20).alias("width"),
        F.when(n % 2 == 0, n * 20).otherwise(500).alias("height"))
    items, meta = service_media(elements, fetched, CDN, "eyJvZmZzZXQiOiA0fQ==", 6)
    return items.join(meta, "page_id").select("page_id", "pos", "url", "type", "context", "size_bytes", "priority",
                                              "total_count", "has_more", "next_cursor")


@register("m10_classic_media_app", oracle=_CLASSIC_MEDIA_CTE
          .replace("'Company image: ' || coalesce(nullif(alt, ''), 'Branding content')", "'Image: ' || coalesce(nullif(alt, ''), 'Company image')")
          .replace("'Content image: ' || coalesce(nullif(alt, ''), 'Page content')", "'Image: ' || coalesce(nullif(alt, ''), 'Content image')")
          + "SELECT page_id, media_url, type, context, priority FROM p")
def m10_classic_media_app(spark, sf_dir):
    """M10/M16 as the app labels and scores its media."""
    m = classic_media(gallery_elements(spark, sf_dir), "app").withColumns(
        {"w": F.lit(None).cast("int"), "h": F.lit(None).cast("int")})
    return m.select("page_id", "media_url", "type", "context",
                    priority_classic("context", "type", "w", "h", require_min_width=False).alias("priority"))


# ---------------------------------------------------------------- constraints
_LOW, _HIGH = REQUEST_LIMITS


@register("v6_request_constraints", oracle=f"""
WITH q AS (
  SELECT page_id, CASE page_id % 8 WHEN 5 THEN repeat(url, 200) WHEN 3 THEN NULL ELSE url END AS u,
         [{', '.join(repr(m) for m in REQUEST_MODELS)}, 'gpt-x', NULL][page_id % 5 + 1] AS model,
         CASE WHEN page_id % 7 <> 0 THEN page_id % 55 - 2 END AS lim,
         page_id % 40 - 1 AS total, page_id % 9 AS remaining, page_id % 2 = 0 AS more,
         CASE WHEN page_id % 4 = 0 THEN 'c' END AS nxt
  FROM pages
)
SELECT page_id, list_filter([CASE WHEN u IS NULL THEN 'url is required' END,
    CASE WHEN length(u) > {MAX_URL_LENGTH} THEN 'URL too long (max {MAX_URL_LENGTH} characters)' END,
    CASE WHEN model IS NULL THEN 'model is required' END, CASE WHEN model = 'gpt-x' THEN 'model is not supported' END,
    CASE WHEN lim NOT BETWEEN {_LOW} AND {_HIGH} THEN 'limit must be within {_LOW}..{_HIGH}' END], lambda x: x IS NOT NULL) AS request,
  list_filter([CASE WHEN total < 0 THEN 'total_count must be >= 0' END,
    CASE WHEN remaining > total THEN 'remaining_count exceeds total_count' END,
    CASE WHEN more <> (nxt IS NOT NULL) THEN 'next_cursor must be given exactly when has_more' END], lambda x: x IS NOT NULL) AS meta
FROM q
""")
def v6_request_constraints(spark, sf_dir):
    """V6: constraints of scrape requests and of page metas, one of each for every crawled page."""
    k = F.col("page_id")
    url = F.when(k % 8 == 5, F.repeat("url", 200)).when(k % 8 != 3, F.col("url"))
    model = F.get(F.array(*[F.lit(m) for m in REQUEST_MODELS], F.lit("gpt-x"), F.lit(None)), (k % 5).cast("int"))
    rows = table(spark, sf_dir, "pages").select(
        "page_id", url.alias("u"), model.alias("model"), F.when(k % 7 != 0, k % 55 - 2).alias("limit"),
        (k % 40 - 1).alias("total_count"), (k % 9).alias("remaining_count"), (k % 2 == 0).alias("has_more"),
        F.when(k % 4 == 0, "c").alias("next_cursor"))
    return rows.select("page_id", scrape_request_violations("u").alias("request"), page_meta_violations().alias("meta"))
