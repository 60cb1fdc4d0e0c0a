"""Streaming queries (Z1-Z6) run to completion with Trigger.AvailableNow,
and the batch twins of the per-key state machines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import round_places, utc_instant

from ..operators.metrics import metrics_from_log, rule_windows
from ..session import materialize, materialize_elements, table
from ..sources.html import parse_pages
from ..sources.logs import parse_log_lines, service_log_lines
from ..sources.standin import company_site
from ..streaming.operators import (
    TIMER_STORE, alarm_stream, incremental, request_spans_stream, throttle_batch, throttle_stream, ttl_cache_batch,
    ttl_cache_stream, windowed_metrics_stream,
)
from ..streaming.runner import _dir, arrivals, drain, land
from .intelligent import intelligent
from .queries_company import SITE_SQL, _B
from .queries_metrics import METRICS_SQL, OPEN_AFTER, OPEN_SPANS_SQL, _favg, _fsum
from .registry import ORACLES, register

RPM, BURST = 0.02, 3          # one token per 50 minutes, bursts of 3
TTL = 3600


def _bucket_sql() -> str:
    rate = RPM / 60.0
    return f"""
WITH RECURSIVE e AS (
  SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6, event_id) AS rn
  FROM events
), r AS (
  SELECT user_id, event_id, rn, CAST({BURST} AS DOUBLE) AS tb, {BURST} >= 1 AS allowed,
         CAST({BURST} AS DOUBLE) - 1 AS st_tok, t AS st_last
  FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.rn, x.tb, x.tb >= 1,
         CASE WHEN x.tb >= 1 THEN x.tb - 1 ELSE r.st_tok END,
         CASE WHEN x.tb >= 1 THEN e.t ELSE r.st_last END
  FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1,
       LATERAL (SELECT least(CAST({BURST} AS DOUBLE), r.st_tok + (e.t - r.st_last) * {rate!r}) AS tb) x
)
SELECT user_id, event_id, allowed, (round((tb) * 1000000) / 1000000) AS tokens,
       (round((CASE WHEN tb >= 1 THEN 0.0 ELSE (1 - tb) / {rate!r} END) * 1000000) / 1000000) AS retry_after
FROM r
"""


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", utc_instant("ts").alias("ts"), "user_id")


def _round_throttle(df):
    return df.select("user_id", "event_id", "allowed", round_places("tokens", 6).alias("tokens"),
                     round_places("retry_after", 6).alias("retry_after"))


@register("z1_throttle_batch", oracle=_bucket_sql())
def z1_throttle_batch(spark, sf_dir):
    """Z1 batch twin: token bucket per user over the events (event time)."""
    return _round_throttle(throttle_batch(_events(spark, sf_dir), rpm=RPM, burst=BURST))


@register("z1_throttle_stream", oracle=_bucket_sql())
def z1_throttle_stream(spark, sf_dir):
    """The same token bucket as a stream with per-user state, over
    events landed as four time-ordered files (four micro-batches)."""
    path = land(_events(spark, sf_dir), "events", 4, order_by="ts")
    src = arrivals(spark, path, "event_id long, ts timestamp, user_id long")
    return _round_throttle(drain(throttle_stream(src, rpm=RPM, burst=BURST), "z1"))


def _cache_sql() -> str:
    return f"""
WITH RECURSIVE e AS (
  SELECT CAST(user_id AS VARCHAR) AS cache_key, event_id, epoch_us(ts) / 1e6 AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6, event_id) AS rn
  FROM events
), r AS (
  SELECT cache_key, event_id, rn, false AS hit, t + {TTL} AS exp FROM e WHERE rn = 1
  UNION ALL
  SELECT e.cache_key, e.event_id, e.rn, r.exp > e.t, CASE WHEN r.exp > e.t THEN r.exp ELSE e.t + {TTL} END
  FROM r JOIN e ON e.cache_key = r.cache_key AND e.rn = r.rn + 1
)
SELECT cache_key, event_id, hit FROM r
"""


@register("z4_ttl_cache_batch", oracle=_cache_sql())
def z4_ttl_cache_batch(spark, sf_dir):
    """Z4 batch twin: per-user result cache with a one-hour TTL."""
    return ttl_cache_batch(_events(spark, sf_dir), "user_id", "ts", TTL)


@register("z4_ttl_cache_stream", oracle=_cache_sql())
def z4_ttl_cache_stream(spark, sf_dir):
    """The TTL cache as streaming state with event-time expiry."""
    path = land(_events(spark, sf_dir), "events", 4, order_by="ts")
    src = arrivals(spark, path, "event_id long, ts timestamp, user_id long")
    return drain(ttl_cache_stream(src, "user_id", "ts", TTL), "z4")


def _log_stream(spark, sf_dir):
    lines = service_log_lines(spark, sf_dir)
    ordered = lines.withColumn("ts", F.try_to_timestamp(F.get_json_object("value", "$.timestamp")))
    path = land(ordered, "log", 4, order_by="ts")
    src = arrivals(spark, path, "value string, ts timestamp")
    return parse_log_lines(src.select("value"))


@register("z2_windowed_metrics_stream", oracle=METRICS_SQL + f"""
SELECT CAST(floor(epoch_us(ts) / (300 * CAST(1000000 AS BIGINT))) * 300 AS BIGINT) AS window_epoch, metric,
       count(*) AS samples, {_fsum('value')} AS total, {_favg('value')} AS average
FROM m GROUP BY ALL
""")
def z2_windowed_metrics_stream(spark, sf_dir):
    """5-minute tumbling windows per metric over the streamed service
    log (10-minute watermark, update mode upserted per window)."""
    w = windowed_metrics_stream(_log_stream(spark, sf_dir))
    out = drain(w, "z2", "update", keys=["window_start", "metric"])
    return out.select(F.unix_seconds("window_start").alias("window_epoch"), "metric", "samples",
                      "total", "average")


@register("z2_windowed_metrics_append", oracle=METRICS_SQL + f"""
SELECT CAST(floor(epoch_us(ts) / (300 * CAST(1000000 AS BIGINT))) * 300 AS BIGINT) AS window_epoch, metric,
       count(*) AS samples, {_fsum('value')} AS total, {_favg('value')} AS average
FROM m GROUP BY ALL
""")
def z2_windowed_metrics_append(spark, sf_dir):
    """Z2 in append mode: each window once, when the watermark has passed its end. A request a day later lets the
    last windows go out; its own stay behind."""
    lines = service_log_lines(spark, sf_dir).withColumn("ts", F.try_to_timestamp(F.get_json_object("value", "$.timestamp")))
    path = land(_with_later_request(spark, lines), "log", 4, order_by="ts")
    src = arrivals(spark, path, "value string, ts timestamp")
    w = drain(windowed_metrics_stream(parse_log_lines(src.select("value"))), "z2-append")
    return w.select(F.unix_seconds("window_start").alias("window_epoch"), "metric", "samples", "total", "average")


PAGES_A_FILE = 1000           # pages are parsed by file, and a page is much work for its bytes
WINDOWS = "metric string, period_s int, window_start timestamp, total double, average double"


@register("z3_alarm_stream", oracle=ORACLES["w11_alarm_windows"])
def z3_alarm_stream(spark, sf_dir):
    """Z3: every alarm rule over the metric windows of its period, which
    arrive out of order and up to two hours late (four micro-batches); event-
    time timers give the batch twin's alarms. A window a day later lets the
    last ones go out."""
    wins = materialize(rule_windows(metrics_from_log(parse_log_lines(service_log_lines(spark, sf_dir)))), "windows")
    late = F.pmod(F.xxhash64("metric", "period_s", "window_start"), F.lit(7200))
    wins = wins.withColumn("arrives", F.timestamp_seconds(F.unix_seconds("window_start") + late))
    newest = wins.orderBy(F.desc("window_start")).limit(1).withColumns(
        {c: F.expr(f"{c} + INTERVAL 1 DAY") for c in ("window_start", "arrives")})
    path = land(wins.unionByName(newest), "windows", 4, order_by="arrives")
    src = arrivals(spark, path, WINDOWS)
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, TIMER_STORE)
    try:
        a = drain(alarm_stream(src), "z3")
    finally:
        spark.conf.set(store, before)
    return a.select("alarm", "metric", F.unix_seconds("window_start").alias("window_epoch"), "value", "breach",
                    "run_length", "in_alarm")


@register("z5_request_spans_stream", oracle=METRICS_SQL + """
SELECT 'r' || event_id AS request_id,
       (round(((epoch_us(end_ts) - epoch_us(ts)) / 1e6) * 1000000) / 1000000) AS duration_s, event_type = 'view' AS success
FROM e WHERE event_type IN ('view', 'error')
""")
def z5_request_spans_stream(spark, sf_dir):
    """Stream-stream join pairing request starts with their end/error."""
    s = drain(request_spans_stream(_log_stream(spark, sf_dir)), "z5").filter("end_ts IS NOT NULL")
    return s.select("request_id", round_places("duration_s", 6).alias("duration_s"), "success")


def _with_later_request(spark, lines):
    """Two lines of one more request, a day after all others, as a live log would go on: they move the watermarks of
    starts and ends past the rest."""
    last = lines.agg(F.max("ts").alias("ts"))
    later = last.select(F.explode(F.array(*[
        F.struct(F.to_json(F.struct(F.lit(kind).alias("event_type"),
                                    F.date_format(F.expr(f"ts + INTERVAL 1 DAY + INTERVAL {s} SECOND"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
                                    F.lit(LATER).alias("request_id"))).alias("value"),
                 F.expr(f"ts + INTERVAL 1 DAY + INTERVAL {s} SECOND").alias("ts"))
        for s, kind in enumerate(("request_start", "request_end"))])).alias("l")).select("l.value", "l.ts")
    return lines.unionByName(later)


LATER = "later"


@register("z5_open_spans_stream", oracle=OPEN_SPANS_SQL)
def z5_open_spans_stream(spark, sf_dir):
    """Z5 with a bound of a minute, as a stream-stream left outer join: starts without an end in time come out when the
    watermark evicts them."""
    lines = service_log_lines(spark, sf_dir).withColumn("ts", F.try_to_timestamp(F.get_json_object("value", "$.timestamp")))
    path = land(_with_later_request(spark, lines), "log", 4, order_by="ts")
    src = arrivals(spark, path, "value string, ts timestamp")
    s = drain(request_spans_stream(parse_log_lines(src.select("value")), max_duration=OPEN_AFTER), "z5-open")
    return s.filter(F.col("request_id") != LATER).select(
        "request_id", round_places("duration_s", 6).alias("duration_s"), "success")


@register("z6_incremental_intelligent", oracle=SITE_SQL + f"""
, b AS (SELECT *, CASE WHEN is_home AND k % 3 = 1 THEN base || 'about' ELSE url END AS best_about_url,
               CASE WHEN is_home AND k % 3 = 1 THEN about_text ELSE page_text END AS best_text FROM crawl)
SELECT page_id, best_about_url, {_B['founded']} AS founded, {_B['employees']} AS employees,
       {_B['confidence']} AS confidence,
       CASE WHEN {_B['use_ai']} THEN 'ai_enhanced' ELSE 'programmatic' END AS approach_used
FROM b
""")
def z6_incremental_intelligent(spark, sf_dir):
    """New crawl pages arrive as a stream (four micro-batches); each
    batch runs the intelligent plan against the whole crawl for About
    lookups; results are appended per batch."""
    site = company_site(spark, sf_dir)
    corpus = materialize_elements(parse_pages(site), "site-elements")
    path = land(site, "pages", 4, order_by="page_id", file_rows=PAGES_A_FILE)
    src = arrivals(spark, path, "page_id long, url string, html string")
    sink = _dir(site, "sink", "z6")
    chk = _dir(site, "chk", "z6")

    def plan(batch):
        env = intelligent(materialize_elements(parse_pages(batch), "batch-elements"), corpus=corpus)
        return env.select(
            "page_id", "best_about_url", "company_info.founded", "company_info.employees",
            "company_info.confidence", "approach_used")

    incremental(src, plan, sink, chk).awaitTermination()
    return spark.read.parquet(sink).drop("batch")
