"""Structured service logs (JSON lines) and a stand-in log built from
the driver's ``events`` table.

A log line is ``{"event_type", "timestamp" (ISO), "request_id", "data"}``
with ``data`` shaped per event type (request_start, request_end,
request_error, llm_interaction, media_processing, cache_interaction).
Lines are parsed into a VARIANT, so unknown or malformed lines survive as
NULL fields instead of failing the job (PERMISSIVE).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import DEFAULT_MODEL, FALLBACK_MODEL
from ..functions.numeric import utc_instant
from ..session import table

LOG_COLUMNS = ["event_type", "ts", "request_id", "data"]


def parse_log_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """JSON text lines -> (event_type, ts, request_id, data VARIANT, raw)."""
    v = F.try_parse_json(F.col(col))
    return lines.select(
        F.try_variant_get(v, "$.event_type", "string").alias("event_type"),
        F.try_to_timestamp(F.try_variant_get(v, "$.timestamp", "string")).alias("ts"),
        F.try_variant_get(v, "$.request_id", "string").alias("request_id"),
        F.try_variant_get(v, "$.data", "variant").alias("data"),
        F.col(col).alias("raw"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Read JSON-lines log files (text source) and parse them."""
    return parse_log_lines(spark.read.text(path))


def write_log(lines: DataFrame, path: str) -> None:
    """S13/S14 sink: JSON lines, one per event."""
    lines.select("value").write.mode("append").text(path)


def service_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in service log from ``events``: each event becomes the log
    line(s) of one service interaction, keyed by ``r{event_id}``:

    view -> request_start + request_end (duration = value s); error ->
    request_start + request_error; purchase -> llm_interaction
    (tokens from props.k); click -> cache_interaction (Hit unless
    k % 5 = 0); signup -> media_processing (image unless k % 3 = 0)."""
    e = table(spark, sf_dir, "events").select(
        "event_id", utc_instant("ts").alias("ts"), "event_type", "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"))
    rid = F.concat(F.lit("r"), F.col("event_id"))
    # ISO-8601 with an explicit offset, so readers need no time zone
    iso = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    end_iso = F.date_format(F.col("ts") + F.make_dt_interval(secs=F.col("value")),
                            "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")

    def line(event_type, ts_iso, data):
        return F.to_json(F.struct(F.lit(event_type).alias("event_type"), ts_iso.alias("timestamp"),
                                  rid.alias("request_id"), data.alias("data")))

    start = line("request_start", iso, F.struct(F.concat(F.lit("https://site"), F.col("k"),
                                                         F.lit(".example.com/")).alias("url")))
    end = line("request_end", end_iso, F.struct(F.col("value").alias("duration"), F.lit(True).alias("success")))
    err = line("request_error", end_iso, F.struct(F.lit("upstream failed").alias("error"),
                                                  F.lit("RuntimeError").alias("error_type"),
                                                  F.col("value").alias("duration")))
    llm = line("llm_interaction", iso, F.struct(
        F.when(F.col("k") % 2 == 0, DEFAULT_MODEL).otherwise(FALLBACK_MODEL).alias("model"),
        (F.col("k") * 40).alias("prompt_tokens"), (F.col("k") * 10).alias("completion_tokens"),
        (F.col("value") / 10).alias("duration"), F.lit(True).alias("success")))
    cache = line("cache_interaction", iso, F.struct(
        F.when(F.col("k") % 5 == 0, "Miss").otherwise("Hit").alias("operation"),
        F.lit(True).alias("success"), (F.col("value") / 1000).alias("duration")))
    media = line("media_processing", iso, F.struct(
        F.concat(F.lit("https://cdn.example.com/m"), F.col("event_id")).alias("url"),
        F.when(F.col("k") % 3 == 0, "video").otherwise("image").alias("type"),
        (F.col("k") * 1000).alias("size_bytes"), (F.col("value") / 10).alias("processing_time"),
        F.lit(True).alias("success")))
    et = F.col("event_type")
    lines = (F.when(et == "view", F.array(start, end)).when(et == "error", F.array(start, err))
             .when(et == "purchase", F.array(llm)).when(et == "click", F.array(cache))
             .when(et == "signup", F.array(media)).otherwise(F.array()))
    return e.select(F.explode(lines).alias("value"))
