"""Q-D: the classic profile + media flow (combined endpoint) for every page.

Profile: About page by the fallback ladder (A3-A6) -> try [About page,
given page] in order (A10) -> prompt (L1) -> model (L2, gated user
function, fallback model L8) -> parse (L3) -> first candidate with a
meaningful profile (F12) -> section mapping and location (X7, X6) or the
failure default (X10).
Media: HTML media of the About page (M10-M12) plus media named in the LLM
result (M13) -> first-seen dedupe (M15) -> context priority (M16) ->
priority order (W3). Combined: J5.

Both outputs are tables keyed by page_id; the media list is not nested
into the profile row, so no per-page array grows without bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.json_media import ai_media, first_seen
from ..operators.links import classic_about_page, page_texts
from ..operators.llm import ModelFn, build_prompt, classic_profile, enrich, failure_profile, meaningful_profile
from ..operators.media import classic_media, priority_classic
from ..session import materialize
from ..operators.paging import position_within, slice_of

DEFAULT_SYSTEM = ("Extract the company profile as JSON with the sections About Us (including "
                  "locations), Our Culture, Our Team, Noteworthy & Differentiated.")


def classic_combined(elements: DataFrame, model_fn: ModelFn, fallback_fn: ModelFn | None = None,
                     system_prompt: str = DEFAULT_SYSTEM, corpus: DataFrame | None = None
                     ) -> tuple[DataFrame, DataFrame]:
    corpus = elements if corpus is None else corpus
    corpus_urls = corpus.filter(F.col("tag") == "[document]").select("url", F.col("page_id").alias("cpid"))
    about = classic_about_page(elements, corpus_urls.select("url"))
    # A10: candidates in order, the About page first when it differs
    cands = about.select("page_id", "url", F.posexplode(
        F.when(F.col("about_url") != F.col("url"), F.array("about_url", "url")).otherwise(F.array("url")))
        .alias("try_rank", "try_url"))
    # a recrawled url keeps the text of its lowest page_id: one model call
    texts = page_texts(corpus).groupBy(F.col("about_url").alias("try_url")).agg(
        F.min_by("about_text", "about_page_id").alias("text"))
    cands = cands.join(texts, "try_url", "inner")            # unfetchable candidates are skipped
    cands = cands.withColumn("prompt", build_prompt(F.lit(system_prompt), F.col("text")))
    answered = enrich(cands.select("page_id", "url", "try_rank", "try_url", "prompt"), model_fn, fallback_fn)
    answered = answered.withColumn("meaningful", F.coalesce(meaningful_profile("result"), F.lit(False)))
    # model answers feed both the profile and the media branch: persist them
    # so the model runs once per candidate
    answered = materialize(answered, "llm-answers")
    good = answered.filter("meaningful").groupBy("page_id").agg(
        F.min_by(F.struct("try_url", F.to_json("result").alias("result_json")), "try_rank").alias("g"))
    prof = about.join(good, "page_id", "left")
    parsed = F.try_parse_json(F.col("g.result_json"))
    ok = F.col("g").isNotNull()
    p = classic_profile(parsed)
    profile = prof.select(
        "page_id", F.when(ok, F.col("g.try_url")).otherwise(F.col("url")).alias("url_scraped"),
        F.when(ok, F.struct(p["about_us"], p["our_culture"], p["our_team"], p["noteworthy_and_differentiated"],
                            p["locations"], F.lit(True).alias("success"), F.lit(None).cast("string").alias("error")))
        .otherwise(failure_profile(F.lit("Could not extract profile information"))).alias("profile"))

    # media of the About page (scrape_url) from HTML and from its LLM result
    scrape = about.select("page_id", F.col("about_url").alias("scrape_url"))
    scrape = scrape.join(corpus_urls.withColumnRenamed("url", "scrape_url"), "scrape_url", "left")
    html = classic_media(corpus).withColumnRenamed("page_id", "cpid")
    html = scrape.join(html, "cpid", "inner").drop("cpid", "scrape_url")
    llm_rows = answered.filter(F.col("try_rank") == 0).filter(F.col("result").isNotNull()).select(
        "page_id", F.to_json("result").alias("result_json"))
    llm = ai_media(llm_rows, "result_json", ["page_id"])
    media = first_seen(html, llm)
    media = media.withColumn("width", F.lit(None).cast("int")).withColumn("height", F.lit(None).cast("int"))
    media = media.withColumn("priority", priority_classic("context", "type", "width", "height"))
    # the full stable priority order per page, numbered without gathering a
    # page in one task (position_within splits hot pages)
    media = position_within(media, "page_id", [F.col("priority").desc(), F.col("o")],
                            [-F.col("priority"), "o.src", "o.pass_no", slice_of("o.node_id")], "rank").drop(
        "width", "height")
    return profile, media


def combine(profile: DataFrame, media: DataFrame) -> DataFrame:
    """success = profile and media succeeded; error = profile error or
    media error; url from the profile; media counted (the list stays a
    separate table)."""
    n = media.groupBy("page_id").agg(F.count("*").alias("media_count"))
    j = profile.join(n, "page_id", "left")
    return j.select("page_id", "url_scraped", F.col("profile.success").alias("success"),
                    F.col("profile.error").alias("error"), "profile",
                    F.coalesce("media_count", F.lit(0)).alias("media_count"))
