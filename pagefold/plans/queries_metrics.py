"""Metric/monitoring queries over the service log derived from ``events``
(S13, G5-G10, G14, J9, J10, W11, Z5 batch twin)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import fixed_sum, round_places

from ..functions.constants import MODEL_PRICES
from ..operators.metrics import (
    alarm_evaluation, cache_rollup, dashboard_stats, llm_calls, llm_cost_rollup, metrics_from_log,
    request_spans, threshold_flags,
)
from ..session import materialize
from ..sources.logs import parse_log_lines, service_log_lines
from .registry import register

(_M0, _IN0, _OUT0), (_M1, _IN1, _OUT1) = MODEL_PRICES


def service_log(spark, sf_dir):
    """The parsed service log, stored: its lines are scanned and parsed once,
    and each branch of a query reads the columns it needs."""
    return materialize(parse_log_lines(service_log_lines(spark, sf_dir)), "service-log")


# DuckDB: the metric rows every event implies, straight from ``events``.
METRICS_SQL = f"""
WITH e AS (
  SELECT event_id, ts, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS end_ts
  FROM events
), calls AS (
  SELECT event_id, ts, k, value / 10 AS duration, k * 40 AS prompt_tokens, k * 10 AS completion_tokens,
         CASE WHEN k % 2 = 0 THEN k * 40 * {_IN0} / 1000 + k * 10 * {_OUT0} / 1000
              ELSE k * 40 * {_IN1} / 1000 + k * 10 * {_OUT1} / 1000 END AS cost
  FROM e WHERE event_type = 'purchase'
), m AS (
  SELECT end_ts AS ts, 'RequestDuration' AS metric, value FROM e WHERE event_type IN ('view', 'error')
  UNION ALL SELECT end_ts, 'SuccessfulRequests', 1.0 FROM e WHERE event_type = 'view'
  UNION ALL SELECT end_ts, 'FailedRequests', 1.0 FROM e WHERE event_type = 'error'
  UNION ALL SELECT end_ts, 'Errors', 1.0 FROM e WHERE event_type = 'error'
  UNION ALL SELECT ts, 'LLMLatency', duration FROM calls
  UNION ALL SELECT ts, 'PromptTokens', prompt_tokens FROM calls
  UNION ALL SELECT ts, 'CompletionTokens', completion_tokens FROM calls
  UNION ALL SELECT ts, 'TotalTokens', prompt_tokens + completion_tokens FROM calls
  UNION ALL SELECT ts, 'cost_estimate_usd', cost FROM calls
  UNION ALL SELECT ts, 'MediaProcessingTime', value / 10 FROM e WHERE event_type = 'signup'
  UNION ALL SELECT ts, 'MediaSize', k * 1000 FROM e WHERE event_type = 'signup'
  UNION ALL SELECT ts, CASE WHEN k % 3 = 0 THEN 'VideoCount' ELSE 'ImageCount' END, 1.0 FROM e WHERE event_type = 'signup'
  UNION ALL SELECT ts, 'CacheLatency', value / 1000 FROM e WHERE event_type = 'click'
  UNION ALL SELECT ts, CASE WHEN k % 5 = 0 THEN 'CacheMisss' ELSE 'CacheHits' END, 1.0 FROM e WHERE event_type = 'click'
  UNION ALL SELECT ts, 'CacheMisses', 1.0 FROM e WHERE event_type = 'click' AND k % 5 = 0
)
"""


def _fsum(x: str) -> str:
    """Exact fixed-point sum (DECIMAL(38,9)) as double."""
    return f"CAST(sum(CAST({x} AS DECIMAL(38,9))) AS DOUBLE)"


def _favg(x: str) -> str:
    """Average from the exact nano-unit sum, half-up at 6 decimals."""
    s = f"CAST(sum(CAST({x} AS DECIMAL(38,9))) * 1000000000 AS HUGEINT)"
    n = f"count({x})"
    return f"(CAST((2 * {s} + {n} * 1000) // (2 * {n} * 1000) AS DOUBLE) / 1000000)"


def _wstart(p: int) -> str:
    return f"CAST(floor(epoch_us(ts) / ({p} * CAST(1000000 AS BIGINT))) * {p} AS BIGINT)"


@register("g5_g8_metric_totals", oracle=METRICS_SQL + f"""
SELECT metric, count(*) AS samples, {_fsum('value')} AS total FROM m GROUP BY metric
""")
def g5_g8_metric_totals(spark, sf_dir):
    """S13+G5-G8+G9: parse the JSON log, emit every interaction's metrics,
    total them per metric."""
    m = metrics_from_log(service_log(spark, sf_dir))
    return m.groupBy("metric").agg(F.count("*").alias("samples"), fixed_sum("value").alias("total"))


_DASH = "(VALUES " + ", ".join(
    f"('{m}', '{s}', {p})" for m, s, p in __import__(
        "pagefold.functions.constants", fromlist=["DASHBOARD_STATS"]).DASHBOARD_STATS) + ") AS d(metric, stat, period_s)"


@register("g10_z2_dashboard_windows", oracle=METRICS_SQL + f"""
, j AS (SELECT m.*, d.stat, d.period_s FROM m JOIN {_DASH} USING (metric))
SELECT metric, stat, CAST(period_s AS INTEGER) AS period_s,
       CAST(floor(epoch_us(ts) / (period_s * CAST(1000000 AS BIGINT))) * period_s AS BIGINT) AS window_epoch,
       CASE WHEN stat = 'Average' THEN {_favg('value')} ELSE {_fsum('value')} END AS value,
       count(*) AS samples
FROM j GROUP BY metric, stat, period_s, window_epoch
""")
def g10_z2_dashboard_windows(spark, sf_dir):
    """G10/Z2 (batch twin): dashboard Average/Sum per tumbling window."""
    d = dashboard_stats(metrics_from_log(service_log(spark, sf_dir)))
    return d.select("metric", "stat", "period_s", F.unix_seconds("window_start").alias("window_epoch"),
                    "value", "samples")


_RULES = "(VALUES " + ", ".join(
    f"('{a}', '{m}', '{s}', {t}, {p}, {n}, '{c}')" for a, m, s, t, p, n, c in __import__(
        "pagefold.functions.constants", fromlist=["ALARM_RULES"]).ALARM_RULES
) + ") AS r(alarm, metric, stat, threshold, period_s, n, cmp)"


@register("w11_alarm_windows", oracle=METRICS_SQL + f"""
, mh AS (SELECT * FROM m UNION ALL
         SELECT ts, 'CacheHitRate', CASE WHEN metric = 'CacheHits' THEN 1.0 ELSE 0.0 END FROM m
         WHERE metric IN ('CacheHits', 'CacheMisses')),
w AS (SELECT alarm, r.metric, stat, threshold, period_s, n, cmp,
             CAST(floor(epoch_us(ts) / (period_s * CAST(1000000 AS BIGINT))) AS BIGINT) AS w_idx,
             CASE WHEN stat = 'Average' THEN {_favg('value')} ELSE {_fsum('value')} END AS v
      FROM mh JOIN {_RULES} USING (metric) GROUP BY alarm, r.metric, stat, threshold, period_s, n, cmp, w_idx),
b AS (SELECT *, CASE WHEN cmp = 'GreaterThanThreshold' THEN v > threshold ELSE v < threshold END AS breach FROM w),
runs AS (SELECT alarm, w_idx, row_number() OVER (PARTITION BY alarm, grp ORDER BY w_idx) AS run_length
         FROM (SELECT alarm, w_idx, w_idx - row_number() OVER (PARTITION BY alarm ORDER BY w_idx) AS grp
               FROM b WHERE breach))
SELECT b.alarm, b.metric, w_idx * period_s AS window_epoch, v AS value, breach,
       CAST(coalesce(run_length, 0) AS INTEGER) AS run_length, coalesce(run_length, 0) >= n AS in_alarm
FROM b LEFT JOIN runs USING (alarm, w_idx)
""")
def w11_alarm_windows(spark, sf_dir):
    """W11/Z3 (batch twin)/J10: alarm statistic, breach and N-consecutive
    in-alarm state per rule and window."""
    a = alarm_evaluation(metrics_from_log(service_log(spark, sf_dir)))
    return a.select("alarm", "metric", F.unix_seconds("window_start").alias("window_epoch"),
                    "value", "breach", F.col("run_length").cast("int").alias("run_length"),
                    "in_alarm")


@register("g9_llm_cost_rollup", oracle=METRICS_SQL + f"""
SELECT 'hour' AS period, {_wstart(3600)} AS window_epoch, (round((sum(cost)) * 100000000) / 100000000) AS cost_usd,
       CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
       count(*) AS calls
FROM calls GROUP BY ALL
UNION ALL
SELECT 'day', {_wstart(86400)}, (round((sum(cost)) * 100000000) / 100000000), CAST(sum(prompt_tokens) AS BIGINT), CAST(sum(completion_tokens) AS BIGINT), count(*)
FROM calls GROUP BY ALL
""")
def g9_llm_cost_rollup(spark, sf_dir):
    """LLM cost from the price table, summed per hour and per day."""
    r = llm_cost_rollup(llm_calls(service_log(spark, sf_dir)))
    return r.select("period", F.unix_seconds("window_start").alias("window_epoch"),
                    round_places("cost_usd", 8).alias("cost_usd"), "prompt_tokens", "completion_tokens", "calls")


@register("g14_llm_threshold_flags", oracle=METRICS_SQL + """
SELECT 'r' || event_id AS request_id, prompt_tokens + completion_tokens > 5000 AS tokens_flag,
       cost > 0.10 AS cost_flag, duration > 10 AS latency_flag
FROM calls
""")
def g14_llm_threshold_flags(spark, sf_dir):
    """Per-call token, cost and latency threshold flags."""
    f = threshold_flags(llm_calls(service_log(spark, sf_dir)))
    return f.select("request_id", "tokens_flag", "cost_flag", "latency_flag")


@register("z5_request_spans_batch", oracle=METRICS_SQL + """
SELECT 'r' || event_id AS request_id,
       (round(((epoch_us(end_ts) - epoch_us(ts)) / 1e6) * 1000000) / 1000000) AS duration_s, event_type = 'view' AS success
FROM e WHERE event_type IN ('view', 'error')
""")
def z5_request_spans_batch(spark, sf_dir):
    """Z5 batch twin: request_start paired with request_end/error."""
    s = request_spans(service_log(spark, sf_dir)).filter("end_ts IS NOT NULL")
    return s.select("request_id", round_places("duration_s", 6).alias("duration_s"), "success")


#: Spans that take longer than a minute count as open (about a third of the log's).
OPEN_AFTER = "1 minute"
OPEN_SPANS_SQL = METRICS_SQL + """
SELECT 'r' || event_id AS request_id,
       CASE WHEN in_time THEN (round(((epoch_us(end_ts) - epoch_us(ts)) / 1e6) * 1000000) / 1000000) END AS duration_s,
       CASE WHEN in_time THEN event_type = 'view' END AS success
FROM (SELECT *, end_ts <= ts + INTERVAL 1 MINUTE AS in_time FROM e WHERE event_type IN ('view', 'error'))
"""


@register("z5_open_spans_batch", oracle=OPEN_SPANS_SQL)
def z5_open_spans_batch(spark, sf_dir):
    """Z5 batch twin with a bound of a minute: starts without an end in time stay, with nulls."""
    s = request_spans(service_log(spark, sf_dir), OPEN_AFTER)
    return s.select("request_id", round_places("duration_s", 6).alias("duration_s"), "success")


@register("g8_cache_windows", oracle=METRICS_SQL + f"""
SELECT {_wstart(300)} AS window_epoch, CAST(count_if(metric = 'CacheHits') AS BIGINT) AS hits,
       CAST(count_if(metric = 'CacheMisses') AS BIGINT) AS misses,
       (round((count_if(metric = 'CacheHits') / (count_if(metric = 'CacheHits') + count_if(metric = 'CacheMisses'))) * 1000000) / 1000000) AS hit_rate,
       {_favg("CASE WHEN metric = 'CacheLatency' THEN value END")} AS avg_latency_s
FROM m WHERE metric IN ('CacheHits', 'CacheMisses', 'CacheLatency') GROUP BY ALL
""")
def g8_cache_windows(spark, sf_dir):
    """Cache hits, misses, hit rate and latency per 5-minute window."""
    c = cache_rollup(metrics_from_log(service_log(spark, sf_dir)))
    return c.select(F.unix_seconds("window_start").alias("window_epoch"), "hits", "misses",
                    round_places("hit_rate", 6).alias("hit_rate"), "avg_latency_s")
