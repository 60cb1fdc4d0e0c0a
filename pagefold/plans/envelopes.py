"""The response envelopes as JSON text, one per page, in the shapes
the reference's API returns (for sinks that hand results to API clients).

Per-request wall-clock fields (``processing_time_seconds``, the v4
``notes`` timing) have no meaning for a batch over a crawl and are NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

V4_MESSAGE = "URL scraping completed successfully"


def v4_envelope_json(v4: DataFrame) -> DataFrame:
    """``text_v4`` rows -> ``{"statusCode", "message", "scrapingData": {...}}``."""
    data = F.struct("page_title", "url", "language", "summary", "sections", "key_values", "media",
                    F.lit(None).cast("string").alias("notes"))
    env = F.struct(F.lit(200).alias("statusCode"), F.lit(V4_MESSAGE).alias("message"),
                   data.alias("scrapingData"))
    return v4.select("page_id", F.to_json(env, {"ignoreNullFields": "false"}).alias("envelope"))


def media_envelope_json(media_env: DataFrame) -> DataFrame:
    """``media_endpoint`` rows -> the split ``/scrape/media`` response."""
    env = F.struct(F.col("success"), F.col("media_assets"), F.col("media_summary"), F.col("pagination"),
                   F.lit(None).cast("double").alias("processing_time_seconds"),
                   F.lit("programmatic_only").alias("approach_used"))
    return media_env.select("page_id", F.to_json(env, {"ignoreNullFields": "false"}).alias("envelope"))


def intelligent_envelope_json(env: DataFrame) -> DataFrame:
    """``intelligent`` rows -> the hybrid ``/scrape/intelligent`` response."""
    cols = [c for c in env.columns if c != "page_id"]
    body = F.struct(*[F.col(c) for c in cols], F.lit(None).cast("double").alias("processing_time_seconds"))
    return env.select("page_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("envelope"))
