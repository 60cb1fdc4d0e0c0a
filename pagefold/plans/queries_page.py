"""Queries over the raw crawl pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_whitespace, normalize_url, truncate
from ..operators.page import link_list, links, page_fields, page_header
from ..session import materialize_elements, table
from ..sources.html import parse_pages
from .registry import register

# DuckDB: decode the entities that occur in the corpus titles (&amp; last,
# then the legacy no-semicolon form).
_DECODE = ("replace(replace(replace(replace(replace({x}, '&quot;', '\"'), '&lt;', '<'), "
           "'&gt;', '>'), '&amp;', '&'), '&amp', '&')")


def elements_of(spark, sf_dir):
    return materialize_elements(parse_pages(table(spark, sf_dir, "pages")), "page-elements")


@register("p2_p4_page_header", oracle=f"""
SELECT page_id,
       trim({_DECODE.format(x="regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS title,
       nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS language,
       'No description found' AS description,
       CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS link_count
FROM pages
""")
def p2_p4_page_header(spark, sf_dir):
    """S1+S2+P2/P3/P4: title, description default, language and the number
    of ``a[href]`` elements per page."""
    el = elements_of(spark, sf_dir)
    head = page_header(el).select("page_id", "title", "description", "language")
    n_links = links(el).groupBy("page_id").agg(F.count("*").alias("link_count"))
    return head.join(n_links, "page_id", "left").select(
        "page_id", "title", "language", "description",
        F.coalesce("link_count", F.lit(0)).cast("bigint").alias("link_count"))


@register("p11_first_links", oracle="""
WITH a AS (
  SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS url,
         unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text,
         generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1) AS pos
  FROM pages
), kept AS (
  SELECT page_id, url, trim(text) AS text, pos FROM a WHERE trim(text) <> '' AND url <> ''
)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS ord, text, url
FROM kept QUALIFY ord <= 10
""")
def p11_first_links(spark, sf_dir):
    """First 10 links with non-empty text and href, per page."""
    return link_list(elements_of(spark, sf_dir), 10)


# DuckDB: page text by stripping script/style/comments/doctype and tags with
# regexes, decoding the entities present in the corpus, then P7/P9 in SQL.
_TEXT_CTE = r"""
WITH s AS (
  SELECT page_id, url,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '<script[^>]*>.*?</script>', '', 'gs'), '<style[^>]*>.*?</style>', '', 'gs'), '<!--.*?-->', '', 'gs'),
      '<!DOCTYPE[^>]*>', '', 'gi'), '<[a-zA-Z/][^>]*>', '', 'g') AS t0
  FROM pages
), d AS (
  SELECT page_id, url, replace(replace(replace(replace(replace(replace(replace(t0, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'),
         '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '&amp', '&') AS doc FROM s
), c AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(flatten(list_transform(
           string_split_regex(doc, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'),
           lambda l: string_split(trim(l), '  '))), lambda x: trim(x)), lambda x: x <> ''), ' ') AS text
  FROM d
)
"""
_TEXT_SQL = _TEXT_CTE + r"""
SELECT page_id, CASE WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN url ELSE 'https://' || url END AS url,
       CASE WHEN length(text) > 1000 THEN left(text, 1000) || '...' ELSE text END AS text_content,
       CAST(length(text) AS INTEGER) AS text_length
FROM c
"""


@register("p1_p7_p9_basic_text", oracle=_TEXT_SQL)
def p1_p7_p9_basic_text(spark, sf_dir):
    """P1+P7+P9 (basic variant): normalised url, cleaned page text cut at
    1000 characters with "..." and its full length."""
    f = page_fields(elements_of(spark, sf_dir))
    text = clean_whitespace("doc_text")
    return f.select("page_id", normalize_url("url").alias("url"),
                    truncate(text, 1000).alias("text_content"),
                    F.length(text).alias("text_length"))


@register("basic_scrape_envelope", oracle=_TEXT_CTE + f"""
SELECT c.page_id,
       trim({_DECODE.format(x="regexp_extract(p.html, '<title>([^<]*)</title>', 1)")}) AS title,
       'No description found' AS description,
       CASE WHEN length(c.text) > 1000 THEN left(c.text, 1000) || '...' ELSE c.text END AS text_content,
       CAST(least(10, len(list_filter(regexp_extract_all(p.html, '<a href="([^"]*)">([^<]*)</a>', 2),
                                      lambda t: trim(t) <> ''))) AS INTEGER) AS n_links
FROM c JOIN pages p USING (page_id)
""")
def basic_scrape_envelope(spark, sf_dir):
    """Basic /scrape per crawled page: title, description, text (1000
    characters) and up to 10 links."""
    from .endpoints import basic_scrape
    e = basic_scrape(elements_of(spark, sf_dir))
    return e.select("page_id", "title", "description", "text_content", F.size("links").alias("n_links"))
