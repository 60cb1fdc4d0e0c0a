"""Content sections.

Four passes in order — headings; divs whose class matches
section|about|mission|team|contact (case-insensitive); articles; main and
section elements. An element is skipped if its stripped text is empty or
was already taken; the first 10 survive. With ``pass_no`` and ``node_id`` as
the order this is "first row per distinct text" (a partial aggregate)
followed by a per-page first-k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import (
    SECTION_CLASS_REGEX, SECTION_EXCERPT_CHARS, SECTION_NAME_CHARS, SECTION_SUMMARY_CHARS,
)
from ..functions.text import title_case, truncate
from ..sources.html import with_text
from .topk import first_k

# one character beyond the longest cut, so a cut still shows
TEXT_KEPT = max(SECTION_NAME_CHARS, SECTION_SUMMARY_CHARS, SECTION_EXCERPT_CHARS) + 1


def sections(elements: DataFrame, max_sections: int = 10) -> DataFrame:
    tag = F.col("tag")
    joined = F.array_join(F.coalesce(F.col("classes"), F.array()), " ")
    pass_no = (F.when(tag.isin("h1", "h2", "h3", "h4", "h5", "h6"), 1)
               .when((tag == "div") & joined.rlike("(?i)" + SECTION_CLASS_REGEX), 2)
               .when(tag == "article", 3)
               .when(tag.isin("main", "section"), 4))
    scoped = elements.filter(tag.isin("h1", "h2", "h3", "h4", "h5", "h6", "div", "article", "main", "section") & pass_no.isNotNull())
    # equal texts share a digest, and no output reads more than the longest
    # excerpt, so the text itself is neither a shuffle key nor carried along
    cand = with_text(elements, scoped).filter(F.col("text_stripped") != "").select(
        "page_id", "node_id", "tag", "classes", F.sha2("text_stripped", 256).alias("digest"),
        F.left("text_stripped", F.lit(TEXT_KEPT)).alias("txt"), pass_no.alias("pass_no"))
    first = cand.groupBy("page_id", "digest").agg(
        F.min_by(F.struct("tag", "classes", "txt"), F.struct("pass_no", "node_id")).alias("e"),
        F.min(F.struct("pass_no", "node_id")).alias("o"))
    top = first_k(first, ["page_id"], ["o"], min(10, max_sections), "ord").withColumn("txt", F.col("e.txt"))
    classes = F.col("e.classes")
    heading = F.col("o.pass_no") == 1
    name = (F.when(heading, truncate("txt", SECTION_NAME_CHARS))
            .when(F.size(F.coalesce(classes, F.array())) > 0,
                  title_case(F.translate(F.array_join(classes, " "), "-_", "  ")))
            .otherwise(F.lit("Content")))
    return top.select("page_id", "ord", name.alias("name"),
                      truncate("txt", SECTION_SUMMARY_CHARS).alias("content_summary"),
                      truncate("txt", SECTION_EXCERPT_CHARS).alias("raw_excerpt"))
