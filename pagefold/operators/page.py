"""Page-level projections over the element table.

Every per-page value is a conditional ``min_by(value, node_id)`` ("first
element in document order that satisfies ...") computed in ONE
``groupBy(page_id)``; min_by is a declarative aggregate with a map-side
partial step, so a page with very many elements still sends one partial
row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import MAIN_CONTENT_CLASSES
from ..functions.text import clean_whitespace, py_strip
from ..sources.html import with_text
from .topk import first_k

DOC = "[document]"


def _first(value: str, cond: str) -> F.Column:
    return F.expr(f"min_by({value}, node_id) FILTER (WHERE {cond})")


def page_fields(elements: DataFrame) -> DataFrame:
    """Raw per-page fields; NULL where the reference's ``find`` finds nothing.

    * ``title_raw`` — first ``<title>`` text, stripped (P2)
    * ``description_raw`` — first ``meta[name=description]`` content, ``""``
      when that tag has no content attribute (P3)
    * ``language`` — first ``html[lang]`` if non-empty, else first
      ``meta[http-equiv=content-language]`` content (P4)
    * ``doc_text`` — ``get_text()`` of the whole page (P5/P6)
    * ``main_text`` — text of the first main, else article, else div with a
      content class, else the page (P8)
    """
    classes = ", ".join(f"'{c}'" for c in MAIN_CONTENT_CLASSES)
    title = _first("text", "tag = 'title'")
    desc = _first("coalesce(attrs['content'], '')",
                  "tag = 'meta' AND attrs['name'] = 'description'")
    html_lang = _first("attrs['lang']", "tag = 'html'")
    meta_lang = _first("attrs['content']",
                       "tag = 'meta' AND attrs['http-equiv'] = 'content-language'")
    main = _first("text", "tag = 'main'")
    article = _first("text", "tag = 'article'")
    div = _first("text", f"tag = 'div' AND arrays_overlap(classes, array({classes}))")
    doc = _first("text", f"tag = '{DOC}'")
    # Only these rows can answer any field: keep them before the aggregate,
    # so its (sort-based, string-valued) partial step sees a few rows per
    # page instead of every element.
    content_div = (F.col("tag") == "div") & F.arrays_overlap(
        "classes", F.array(*[F.lit(c) for c in MAIN_CONTENT_CLASSES]))
    # the IN conjunct reaches the Parquet scan; the class test stays residual
    relevant = (elements.filter(F.col("tag").isin("title", "meta", "html", "main", "article", "div", DOC))
                .filter((F.col("tag") != "div") | content_div))
    agg = relevant.groupBy("page_id").agg(
        F.any_value("url").alias("url"),
        py_strip(title).alias("title_raw"),
        desc.alias("description_raw"),
        F.when(F.coalesce(html_lang, F.lit("")) != "", html_lang)
         .otherwise(meta_lang).alias("language"),
        doc.alias("doc_text"),
        F.coalesce(main, article, div).alias("_main"),
    )
    return agg.withColumn("main_text", F.coalesce("_main", "doc_text")).drop("_main")


def page_header(elements: DataFrame, title_default: str = "No title found",
                description_default: str = "No description found") -> DataFrame:
    """P2/P3/P4/P7 with the hybrid/basic defaults; ``text`` is the cleaned
    page text."""
    f = page_fields(elements)
    return f.select(
        "page_id", "url",
        F.coalesce("title_raw", F.lit(title_default)).alias("title"),
        F.coalesce("description_raw", F.lit(description_default)).alias("description"),
        "language",
        clean_whitespace("doc_text").alias("text"),
    )


def links(elements: DataFrame) -> DataFrame:
    """All ``a[href]`` rows with their stripped text, document order kept in
    ``node_id``."""
    anchors = elements.filter((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull())
    return (with_text(elements, anchors)
            .select("page_id", "url", "node_id",
                    F.col("attrs")["href"].alias("href"),
                    py_strip("text").alias("link_text"),
                    F.col("text").alias("raw_text")))


def link_list(elements: DataFrame, k: int = 10) -> DataFrame:
    """First ``k`` links with non-empty stripped text and href, raw href."""
    ls = links(elements).filter((F.col("link_text") != "") & (F.col("href") != ""))
    return first_k(ls, ["page_id"], ["node_id"], k, "ord").select(
        "page_id", "ord", F.col("link_text").alias("text"), F.col("href").alias("url"))
