"""Queries on the company-site stand-in pages: facts, About discovery,
sections, key/values and the intelligent (Q-A) and text (Q-C) envelopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import HYBRID_PATTERNS, KEY_VALUE_PATTERNS, MISSION_PATTERNS
from ..functions.text import clean_whitespace
from ..operators.facts import ai_gate, hybrid_facts, key_values, split_facts
from ..operators.links import classic_about_page, hybrid_about_links, split_about_links
from ..operators.page import page_fields
from ..operators.paging import position_within, slice_of
from ..operators.sections import sections
from ..plans.intelligent import intelligent
from ..plans.text_v4 import text_v4
from ..session import materialize_elements
from ..sources.html import parse_pages
from ..sources.standin import company_site
from .registry import register


def site_elements(spark, sf_dir):
    return materialize_elements(parse_pages(company_site(spark, sf_dir)), "site-elements")


# ----------------------------------------------------------------- DuckDB side
def _ladder(text: str, patterns, strip: bool = True) -> str:
    parts = []
    for p in patterns:
        val = f"regexp_extract({text}, '{p}', 1)"
        if strip:
            val = f"trim({val})"
        parts.append(f"WHEN regexp_matches({text}, '{p}') THEN {val}")
    return "CASE " + " ".join(parts) + " END"


def _truthy(*cols) -> str:
    return " + ".join(f"(CASE WHEN coalesce({c}, '') <> '' THEN 1 ELSE 0 END)" for c in cols)


# Expected cleaned page texts, assembled from the same columns as the HTML.
SITE_SQL = """
WITH s AS (
  SELECT s_suppkey AS k, s_name AS name, n_name,
         'https://s' || s_suppkey || '.example.com/' AS base,
         CAST(1900 + s_suppkey % 120 AS VARCHAR) AS year,
         CAST(1950 + s_suppkey % 70 AS VARCHAR) AS about_year,
         format('{:,}', s_suppkey * 7) AS emp,
         repeat('Quality parts and service for every order. ', 14) AS filler,
         ['en', 'fr', 'de', 'es'][CAST(s_suppkey % 4 AS INTEGER) + 1] AS lang
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
), t AS (
  SELECT *, CASE k % 4 WHEN 0 THEN 'We make parts for many customers.'
                       WHEN 1 THEN 'Founded in ' || year || '.'
                       WHEN 2 THEN 'Founded in ' || year || '. We have ' || emp || ' employees.'
                       ELSE 'Founded in ' || year || '. We have ' || emp || ' employees. Based in ' || n_name || '.' END AS facts
  FROM s
), site AS (
  SELECT *,
    name || 'About Us' || CASE WHEN k % 2 = 0 THEN 'Our Company' ELSE '' END || 'ProductsTeamAboutContact'
      || name || facts || CASE WHEN k % 8 < 4 THEN filler ELSE '' END
      || 'Our MissionOur mission: to deliver quality parts.Annual report Meet the team'
      || CASE WHEN k % 2 = 1 THEN 'Who we are' ELSE '' END || 'Our StoryAbout' AS home_text,
    name || facts || CASE WHEN k % 8 < 4 THEN trim(filler) ELSE '' END
      || 'Our MissionOur mission: to deliver quality parts.Annual reportMeet the team'
      || CASE WHEN k % 2 = 1 THEN 'Who we are' ELSE '' END AS main_stripped,
    name || facts || CASE WHEN k % 8 < 4 THEN filler ELSE '' END
      || 'Our MissionOur mission: to deliver quality parts.Annual report Meet the team'
      || CASE WHEN k % 2 = 1 THEN 'Who we are' ELSE '' END AS main_text,
    CASE WHEN k % 3 = 1 THEN 'About ' || name || 'About ' || name || 'Established in ' || about_year
                             || '. Our team of ' || (k * 3) || ' people. ' || trim(filler) || ' ' || trim(filler)
         WHEN k % 3 = 2 THEN 'About ' || name || 'About ' || name || 'A short page.' END AS about_text
  FROM t
), crawl AS (   -- every crawled page: home pages and About pages
  SELECT k, k AS page_id, base AS url, true AS is_home, name AS title, home_text AS page_text, main_text,
         CASE WHEN k % 7 = 0 THEN '' WHEN k % 5 <> 0 THEN name || ' supplies parts & tools' END AS description,
         CASE WHEN k % 3 = 0 THEN 'de' ELSE lang END AS page_lang, base, about_text, name, filler FROM site
  UNION ALL
  SELECT k, k + 1000000000, base || 'about', false, 'About ' || name, about_text,
         substr(about_text, length('About ' || name) + 1), NULL, 'en', base, about_text, name, filler
  FROM site WHERE k % 3 <> 0
)
"""


def _hybrid_sql(text: str) -> dict[str, str]:
    low = f"lower({text})"
    f = {k: _ladder(low, HYBRID_PATTERNS[k]) for k in ("founded", "employees", "location")}
    n = _truthy(f["founded"], f["employees"], f["location"])
    conf = f"CASE WHEN {n} >= 3 THEN 'high' WHEN {n} >= 1 THEN 'medium' ELSE 'low' END"
    use = f"({conf} = 'low' OR length({text}) < 500 OR ({n}) < 2)"
    reason = (f"CASE WHEN {use} AND {conf} = 'low' THEN 'Low confidence programmatic results' "
              f"WHEN {use} THEN 'Forced by parameter' ELSE 'Programmatic results were sufficient' END")
    return {**f, "confidence": conf, "use_ai": use, "reason": reason}


_H = _hybrid_sql("page_text")


@register("x1_x2_f11_hybrid_facts", oracle=SITE_SQL + f"""
SELECT page_id, {_H['founded']} AS founded, {_H['employees']} AS employees,
       {_H['location']} AS location, CAST(NULL AS VARCHAR) AS ceo, {_H['confidence']} AS confidence,
       {_H['use_ai']} AS use_ai, {_H['reason']} AS ai_reason
FROM crawl
""")
def x1_x2_f11_hybrid_facts(spark, sf_dir):
    """Hybrid regex facts, confidence and the AI gate on each
    page's cleaned text."""
    f = page_fields(site_elements(spark, sf_dir)).withColumn("text", clean_whitespace("doc_text"))
    f = f.withColumn("facts", hybrid_facts("text")).withColumn("gate", ai_gate(F.col("facts"), "text"))
    return f.select("page_id", "facts.founded", "facts.employees", "facts.location", "facts.ceo",
                    "facts.confidence", F.col("gate.used").alias("use_ai"),
                    F.col("gate.reason").alias("ai_reason"))


_LOWMAIN = "lower(main_text)"


@register("x3_split_facts", oracle=SITE_SQL + f"""
SELECT page_id,
       {_ladder(_LOWMAIN, HYBRID_PATTERNS['founded'][:1], strip=False)} AS founded,
       {_ladder(_LOWMAIN, HYBRID_PATTERNS['employees'][:1], strip=False)} AS employees,
       {_ladder(_LOWMAIN, HYBRID_PATTERNS['location'][:1])} AS location,
       {_ladder(_LOWMAIN, MISSION_PATTERNS)} AS mission,
       CASE WHEN regexp_matches({_LOWMAIN}, '{HYBRID_PATTERNS['founded'][0]}') THEN 'high' ELSE 'medium' END AS confidence
FROM crawl
""")
def x3_split_facts(spark, sf_dir):
    """P8+X3: main-content choice and the split facts (with mission)."""
    f = page_fields(site_elements(spark, sf_dir))
    f = f.withColumn("facts", split_facts(clean_whitespace("main_text")))
    return f.select("page_id", "facts.founded", "facts.employees", "facts.location", "facts.mission",
                    "facts.confidence")


def _kv_sql() -> str:
    parts = []
    for i, (p, key) in enumerate(KEY_VALUE_PATTERNS):
        parts.append(f"SELECT page_id, {i} AS pidx, '{key}' AS key, "
                     f"unnest(regexp_extract_all(lower(page_text), '{p}', 1)) AS raw, "
                     f"generate_subscripts(regexp_extract_all(lower(page_text), '{p}', 1), 1) AS midx FROM crawl")
    return " UNION ALL ".join(parts)


_KV_SQL = f"""
, m AS ({_kv_sql()}),
v AS (SELECT page_id, pidx, midx, key,
             array_to_string(list_transform(regexp_extract_all(trim(raw), '[A-Za-z]+|[^A-Za-z]+', 0),
                 lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z]') THEN upper(left(t, 1)) || lower(substr(t, 2)) ELSE t END), '') AS value
      FROM m WHERE length(trim(raw)) > 1),
d AS (SELECT page_id, key, value, min(pidx * 100000 + midx) AS o FROM v GROUP BY page_id, key, value),
kv AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY o) AS INTEGER) AS ord, key, value
       FROM d QUALIFY ord <= 10)
"""


@register("x5_key_values", oracle=SITE_SQL + _KV_SQL + "SELECT * FROM kv")
def x5_key_values(spark, sf_dir):
    """X5+Q4: v4 key/values (all matches, title-cased, distinct, first 10)."""
    f = page_fields(site_elements(spark, sf_dir)).withColumn("text", clean_whitespace("doc_text"))
    return key_values(f, "text")


@register("a1_hybrid_about_links", oracle=SITE_SQL + """
, l AS (
  SELECT k, 1 AS pos, base || 'about' AS about_url, 'About Us' AS text, 'high' AS confidence FROM site
  UNION ALL SELECT k, 2, base || 'Company', 'Our Company', 'high' FROM site WHERE k % 2 = 0
  UNION ALL SELECT k, 3, base || 'our-team', 'Team', 'medium' FROM site
  UNION ALL SELECT k, 4, base || 'our-story', 'Our Story', 'medium' FROM site
)
SELECT k AS page_id, CAST(row_number() OVER (PARTITION BY k ORDER BY confidence = 'medium', pos) AS INTEGER) AS rank,
       about_url, text, confidence
FROM l
""")
def a1_hybrid_about_links(spark, sf_dir):
    """J1+A1+W1: about links inside nav/header/footer, first-seen dedupe,
    stable high-before-medium order."""
    ls = hybrid_about_links(site_elements(spark, sf_dir))
    ls = position_within(ls, "page_id", ["sort_key"], ["sort_key.c", "sort_key.pos.outer", slice_of("sort_key.pos.node_id")],
                         "rank")
    return ls.select("page_id", "rank", "about_url", "text", "confidence")


@register("a2_split_about_links", oracle=SITE_SQL + """
, l AS (
  SELECT k, 1 AS pos, base || 'about' AS about_url, 'About Us' AS title, 0.9 AS relevance_score FROM site
  UNION ALL SELECT k, 2, base || 'Company', 'Our Company', 0.9 FROM site WHERE k % 2 = 0
  UNION ALL SELECT k, 3, base || 'our-team', 'Team', 0.9 FROM site
  UNION ALL SELECT k, 4, base || 'team', 'Meet the team', 0.9 FROM site
  UNION ALL SELECT k, 5, base || 'who-we-are', 'Who we are', 0.8 FROM site WHERE k % 2 = 1
  UNION ALL SELECT k, 6, base || 'values', 'About Page', 0.8 FROM site WHERE k % 2 = 1
  UNION ALL SELECT k, 7, base || 'our-story', 'Our Story', 0.9 FROM site
)
SELECT k AS page_id, CAST(row_number() OVER (PARTITION BY k ORDER BY relevance_score DESC, pos) AS INTEGER) AS rank,
       about_url, title, CAST(relevance_score AS DOUBLE) AS relevance_score
FROM l
""")
def a2_split_about_links(spark, sf_dir):
    """A2+W2: split about links scored 0.9/0.8, max-score dedupe, sorted."""
    ls = split_about_links(site_elements(spark, sf_dir))
    ls = position_within(ls, "page_id", ["sort_key"],
                         [-F.col("relevance_score"), slice_of("first_pos.node_id")], "rank")
    return ls.select("page_id", "rank", "about_url", "title", "relevance_score")


def _sections_sql() -> str:
    def tc(x):  # Python str.title() on an ASCII string, in DuckDB
        return ("array_to_string(list_transform(regexp_extract_all(" + x + ", '[A-Za-z]+|[^A-Za-z]+', 0), "
                "lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z]') THEN upper(left(t, 1)) || lower(substr(t, 2)) "
                "ELSE t END), '')")
    rows = [
        "SELECT k, 1 AS o, CASE WHEN length(name) > 50 THEN left(name, 50) || '...' ELSE name END AS name, name AS txt FROM site",
        "SELECT k, 2, 'Our Mission', 'Our Mission' FROM site",
        f"SELECT k, 3, {tc(chr(39) + 'about section' + chr(39))}, facts FROM site",
        "SELECT k, 4, 'Content', main_stripped FROM site",
        f"SELECT k, 5, {tc(chr(39) + 'our mission' + chr(39))}, 'Our MissionOur mission: to deliver quality parts.' FROM site",
    ]
    about = "'About ' || name"
    body = ("CASE WHEN k % 3 = 1 THEN 'Established in ' || about_year || '. Our team of ' || (k * 3) || ' people. ' || filler "
            "|| ' ' || trim(filler) ELSE 'A short page.' END")
    rows += [f"SELECT k + 1000000000, 1, CASE WHEN length({about}) > 50 THEN left({about}, 50) || '...' ELSE {about} END, "
             f"{about} FROM site WHERE k % 3 <> 0",
             f"SELECT k + 1000000000, 2, 'Content', {about} || {body} FROM site WHERE k % 3 <> 0"]
    return " UNION ALL ".join(rows)


@register("p12_sections", oracle=SITE_SQL + f"""
, sec AS ({_sections_sql()})
SELECT k AS page_id, CAST(o AS INTEGER) AS ord, name,
       CASE WHEN length(txt) > 300 THEN left(txt, 300) || '...' ELSE txt END AS content_summary,
       CASE WHEN length(txt) > 150 THEN left(txt, 150) || '...' ELSE txt END AS raw_excerpt
FROM sec
""")
def p12_sections(spark, sf_dir):
    """Four-pass section extraction with exact-text dedupe, first 10."""
    return sections(site_elements(spark, sf_dir))


_B = _hybrid_sql("best_text")


@register("qa_intelligent", oracle=SITE_SQL + f"""
, b AS (
  SELECT *, CASE WHEN is_home AND k % 3 = 1 THEN base || 'about' ELSE url END AS best_about_url,
            CASE WHEN is_home AND k % 3 = 1 THEN about_text ELSE page_text END AS best_text
  FROM crawl
)
SELECT page_id, url, best_about_url, title, coalesce(description, 'No description found') AS description,
       CASE WHEN length(best_text) > 3000 THEN left(best_text, 3000) || '...' ELSE best_text END AS content,
       {_B['founded']} AS founded, {_B['employees']} AS employees, {_B['location']} AS location,
       {_B['confidence']} AS confidence,
       CAST(CASE WHEN NOT is_home THEN 0 WHEN k % 2 = 0 THEN 4 ELSE 3 END AS BIGINT) AS about_pages_found,
       CAST(CASE WHEN NOT is_home OR k % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS about_pages_analyzed,
       CAST(CASE WHEN is_home AND k % 3 <> 0 THEN length(about_text) END AS INTEGER) AS best_candidate_length,
       {_B['use_ai']} AS ai_used, {_B['reason']} AS ai_reason,
       CASE WHEN {_B['use_ai']} THEN 'ai_enhanced' ELSE 'programmatic' END AS approach_used,
       CAST(CASE WHEN is_home THEN 6 + (k % 2) + CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END + CASE WHEN k % 4 = 2 THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS total_assets,
       CAST(CASE WHEN is_home THEN 3 ELSE 0 END AS BIGINT) AS images_count,
       CAST(CASE WHEN is_home THEN 1 + (k % 2) + CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END + CASE WHEN k % 4 = 2 THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS videos_count
FROM b
""")
def qa_intelligent(spark, sf_dir):
    """Q-A: the intelligent scrape per page — header, About discovery,
    best About text over up to 3 fetched About pages, hybrid facts, media
    summary and the AI gate."""
    env = intelligent(site_elements(spark, sf_dir), max_about_pages=3)
    return env.select(
        "page_id", "url", "best_about_url", "title", "description", "content",
        "company_info.founded", "company_info.employees", "company_info.location",
        "company_info.confidence", "about_pages_found",
        F.size("about_page_analysis").alias("about_pages_analyzed"),
        F.try_element_at(F.col("about_page_analysis.content_length"), F.lit(1)).alias("best_candidate_length"),
        F.col("ai_enhancement.used").alias("ai_used"), F.col("ai_enhancement.reason").alias("ai_reason"),
        "approach_used", "media_summary.total_assets", "media_summary.images_count",
        "media_summary.videos_count")


@register("qc_v4_text", oracle=SITE_SQL + _KV_SQL + f"""
, sent AS (
  SELECT page_id, list_filter(list_transform(regexp_split_to_array(page_text, '[.!?]+'), lambda x: trim(x)),
                              lambda x: length(x) > 20) AS kept FROM crawl
), pairs AS (SELECT page_id, string_agg(key || '=' || value, ';' ORDER BY ord) AS key_values FROM kv GROUP BY page_id),
sec AS ({_sections_sql()}),
named AS (SELECT k AS page_id, string_agg(name, ';' ORDER BY o) AS section_names FROM sec GROUP BY k)
SELECT page_id, title AS page_title, url, page_lang AS language,
       CASE WHEN len(kept) = 0 THEN title || ' provides information about their services and offerings.'
            WHEN suffix(array_to_string(kept[1:3], '. '), '.') THEN array_to_string(kept[1:3], '. ')
            ELSE array_to_string(kept[1:3], '. ') || '.' END AS summary,
       section_names, coalesce(key_values, '') AS key_values,
       CASE WHEN is_home THEN base || 'img/logo.png,' || base || 'team.jpg,' || base || 'icons/cart-icon.png' ELSE '' END AS images,
       CAST(CASE WHEN is_home THEN (k % 2) + CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END + CASE WHEN k % 4 = 2 THEN 1 ELSE 0 END
                 ELSE 0 END AS INTEGER) AS n_videos
FROM crawl JOIN sent USING (page_id) JOIN named USING (page_id) LEFT JOIN pairs USING (page_id)
""")
def qc_v4_text(spark, sf_dir):
    """Q-C: the v4 text envelope per page (title, language, summary,
    sections, key/values, media with thumbnails)."""
    env = text_v4(site_elements(spark, sf_dir))
    return env.select("page_id", "page_title", "url", "language", "summary",
                      F.array_join("sections.name", ";").alias("section_names"),
                      F.array_join(F.transform("key_values", lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
                       .alias("key_values"),
                      F.array_join("media.images", ",").alias("images"), F.size("media.videos").alias("n_videos"))


@register("a3_a6_classic_about_page", oracle=SITE_SQL + """
SELECT k AS page_id, base AS about_url, 'self' AS found_by FROM site
UNION ALL SELECT k + 1000000000, base || 'about', 'self' FROM site WHERE k % 3 = 1
UNION ALL SELECT k + 1000000000, base || 'about', 'navigation' FROM site WHERE k % 3 = 2
""")
def a3_a6_classic_about_page(spark, sf_dir):
    """The classic About-page ladder for every crawled page
    (about content on the page itself; else the site root's nav links;
    else the first existing common path; else the page)."""
    el = site_elements(spark, sf_dir)
    urls = el.filter(F.col("tag") == "[document]").select("url")
    return classic_about_page(el, urls).select("page_id", "about_url", "found_by")


@register("fast_scrape_hybrid", oracle=SITE_SQL + f"""
SELECT page_id, title, coalesce(description, 'No description found') AS description,
       CASE WHEN length(page_text) > 2000 THEN left(page_text, 2000) || '...' ELSE page_text END AS content,
       {_H['founded']} AS founded, {_H['employees']} AS employees, {_H['location']} AS location,
       {_H['confidence']} AS confidence,
       CAST(CASE WHEN is_home THEN 6 + (k % 2) + CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END + CASE WHEN k % 4 = 2 THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS total_assets
FROM crawl
""")
def fast_scrape_hybrid(spark, sf_dir):
    """Hybrid /scrape/fast per page: header, text, hybrid facts, media
    summary."""
    from .endpoints import fast_scrape
    e = fast_scrape(site_elements(spark, sf_dir))
    return e.select("page_id", "title", "description", "content", "company_info.founded",
                    "company_info.employees", "company_info.location", "company_info.confidence",
                    "media_summary.total_assets")


@register("split_text_scrape", oracle=SITE_SQL + f"""
SELECT page_id, title, coalesce(description, '') AS description,
       CASE WHEN length(main_text) > 2000 THEN left(main_text, 2000) || '...' ELSE main_text END AS content,
       {_ladder(_LOWMAIN, MISSION_PATTERNS)} AS mission,
       CASE WHEN regexp_matches({_LOWMAIN}, '{HYBRID_PATTERNS['founded'][0]}') THEN 'high' ELSE 'medium' END AS confidence,
       CAST(CASE WHEN NOT is_home THEN 0 WHEN k % 2 = 0 THEN 5 ELSE 6 END AS BIGINT) AS about_pages_found,
       CASE WHEN NOT is_home THEN '' WHEN k % 2 = 0 THEN base || 'about,' || base || 'Company,' || base || 'our-team'
            ELSE base || 'about,' || base || 'our-team,' || base || 'team' END AS top_about_urls
FROM crawl
""")
def split_text_scrape(spark, sf_dir):
    """Split /scrape/text per page: main content, split facts, About
    links found and the top 3 by relevance."""
    from .endpoints import split_text
    e = split_text(site_elements(spark, sf_dir))
    return e.select("page_id", "title", "description", "content", "company_info.mission",
                    "company_info.confidence", "about_pages_found",
                    F.array_join(F.col("about_page_analysis.url"), ",").alias("top_about_urls"))


@register("x4_basic_about_scrape", oracle=SITE_SQL + f"""
SELECT page_id, title,
       CASE WHEN length(main_text) > 2000 THEN left(main_text, 2000) || '...' ELSE main_text END AS content,
       {_ladder(_LOWMAIN, HYBRID_PATTERNS['founded'][:1], strip=False)} AS founded,
       {_ladder(_LOWMAIN, HYBRID_PATTERNS['employees'][:1], strip=False)} AS employees,
       {_ladder(_LOWMAIN, HYBRID_PATTERNS['location'][:1])} AS location
FROM crawl
""")
def x4_basic_about_scrape(spark, sf_dir):
    """X4 basic /scrape/about per page: main content and three facts."""
    from .endpoints import basic_about
    e = basic_about(site_elements(spark, sf_dir))
    return e.select("page_id", "title", "content", "company_info.founded", "company_info.employees",
                    "company_info.location")
