"""Service metrics, cost, dashboards and alarms (G5-G14, J9, J10, W11, Z5 batch).

Metric rows are ``(ts, request_id, metric, value, unit)``. Per-interaction
emitters are one projection producing an array of metric structs that is
exploded; window statistics are ``groupBy`` aggregates (partial
aggregation map-side, so a hot metric does not pile onto one reducer);
the price and rule tables are fixed-size literal tables, broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import fixed_avg, fixed_sum
from ..functions.constants import (
    ALARM_RULES, COST_PER_REQUEST, DASHBOARD_STATS, LATENCY_SECONDS, MODEL_PRICES, TOKENS_PER_REQUEST,
)

METRIC_DDL = "ts timestamp, request_id string, metric string, value double, unit string"


def _d(path: str, typ: str = "double") -> Column:
    return F.try_variant_get(F.col("data"), path, typ)


def _m(name, value, unit) -> Column:
    n = name if isinstance(name, Column) else F.lit(name)
    v = value if isinstance(value, Column) else F.lit(value)
    return F.struct(n.alias("metric"), v.cast("double").alias("value"), F.lit(unit).alias("unit"))


def price_table(spark: SparkSession) -> DataFrame:
    """K13 as a 2-row table (fixed size, safe to broadcast)."""
    return spark.createDataFrame(MODEL_PRICES, "model string, input_per_1k double, output_per_1k double")


def llm_calls(log: DataFrame) -> DataFrame:
    """One row per LLM interaction with tokens and cost."""
    calls = log.filter(F.col("event_type") == "llm_interaction").select(
        "ts", "request_id", _d("$.model", "string").alias("model"),
        _d("$.prompt_tokens", "long").alias("prompt_tokens"),
        _d("$.completion_tokens", "long").alias("completion_tokens"),
        _d("$.duration").alias("duration"), _d("$.success", "boolean").alias("success"))
    prices = F.broadcast(price_table(log.sparkSession))
    j = calls.join(prices, "model", "left")
    cost = (F.col("prompt_tokens") * F.col("input_per_1k") / 1000
            + F.col("completion_tokens") * F.col("output_per_1k") / 1000)
    return j.select("ts", "request_id", "model", "prompt_tokens", "completion_tokens",
                    (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
                    "duration", "success", cost.alias("cost_estimate_usd"))


def metrics_from_log(log: DataFrame) -> DataFrame:
    """The metric rows each logged interaction publishes."""
    et = F.col("event_type")
    dur = _d("$.duration")
    op = _d("$.operation", "string")
    mtype = _d("$.type", "string")
    arr = (
        F.when(et == "request_end", F.array(_m("RequestDuration", dur, "Seconds"),
                                            _m("SuccessfulRequests", 1, "Count")))
        .when(et == "request_error", F.array(_m("RequestDuration", dur, "Seconds"),
                                             _m("FailedRequests", 1, "Count"), _m("Errors", 1, "Count")))
        .when(et == "media_processing", F.array(
            _m("MediaProcessingTime", _d("$.processing_time"), "Seconds"),
            _m("MediaSize", _d("$.size_bytes"), "Bytes"),
            _m(F.concat(F.upper(F.substring(mtype, 1, 1)), F.lower(F.substring(mtype, 2, 1 << 20)),
                        F.lit("Count")), 1, "Count")))
        .when(et == "cache_interaction", F.filter(F.array(
            _m("CacheLatency", dur, "Seconds"),
            _m(F.concat(F.lit("Cache"), op, F.lit("s")), 1, "Count"),
            F.when(op == "Miss", _m("CacheMisses", 1, "Count"))), lambda x: x.isNotNull()))
    )
    base = log.select("ts", "request_id", F.explode(arr).alias("m")).select(
        "ts", "request_id", "m.metric", "m.value", "m.unit")
    calls = llm_calls(log)
    llm = calls.select("ts", "request_id", F.explode(F.array(
        _m("LLMLatency", F.col("duration"), "Seconds"),
        _m("PromptTokens", F.col("prompt_tokens"), "Count"),
        _m("CompletionTokens", F.col("completion_tokens"), "Count"),
        _m("TotalTokens", F.col("total_tokens"), "Count"),
        _m("cost_estimate_usd", F.col("cost_estimate_usd"), "None"))).alias("m")).select(
        "ts", "request_id", "m.metric", "m.value", "m.unit")
    return base.unionByName(llm)


def window_start(ts: Column, period_s: Column) -> Column:
    """Tumbling window start aligned to the epoch, for a per-row period."""
    p = period_s.cast("long") * 1_000_000
    return F.timestamp_micros(F.floor(F.unix_micros(ts) / p).cast("long") * p)


def dashboard_stats(metrics: DataFrame) -> DataFrame:
    """G10/Z2 batch twin: each dashboard metric's Average or Sum over its
    tumbling period (300 s / 3600 s)."""
    spec = metrics.sparkSession.createDataFrame(DASHBOARD_STATS, "metric string, stat string, period_s int")
    j = metrics.join(F.broadcast(spec), "metric")            # 13-row fixed spec
    j = j.withColumn("window_start", window_start(F.col("ts"), F.col("period_s")))
    g = j.groupBy("metric", "stat", "period_s", "window_start").agg(
        fixed_avg("value").alias("avg_v"), fixed_sum("value").alias("sum_v"), F.count("*").alias("samples"))
    return g.select("metric", "stat", "period_s", "window_start",
                    F.when(F.col("stat") == "Average", F.col("avg_v")).otherwise(F.col("sum_v")).alias("value"),
                    "samples")


def with_hit_rate(metrics: DataFrame) -> DataFrame:
    """Add a CacheHitRate sample per cache lookup (1 hit, 0 miss), so
    its Average over a window is the hit ratio."""
    lookups = metrics.filter(F.col("metric").isin("CacheHits", "CacheMisses")).select(
        "ts", "request_id", F.lit("CacheHitRate").alias("metric"),
        F.when(F.col("metric") == "CacheHits", 1.0).otherwise(0.0).alias("value"), F.lit("None").alias("unit"))
    return metrics.unionByName(lookups)


ALARM_RULES_DDL = ("alarm string, metric string, stat string, threshold double, period_s int, "
                   "evaluation_periods int, comparison string")


def alarm_rules(spark: SparkSession) -> DataFrame:
    """K14 as a 7-row table (fixed size, safe to broadcast)."""
    return spark.createDataFrame(ALARM_RULES, ALARM_RULES_DDL)


def rule_windows(metrics: DataFrame) -> DataFrame:
    """Z2 for the alarm rules: every alarmed metric's exact sum and average
    per tumbling window of each period a rule uses -> (metric, period_s,
    window_start, total, average)."""
    periods = sorted({(m, p) for _, m, _, _, p, _, _ in ALARM_RULES})
    spec = metrics.sparkSession.createDataFrame(periods, "metric string, period_s int")
    j = with_hit_rate(metrics).join(F.broadcast(spec), "metric")       # fixed few rows
    j = j.withColumn("window_start", window_start(F.col("ts"), F.col("period_s")))
    return j.groupBy("metric", "period_s", "window_start").agg(
        fixed_sum("value").alias("total"), fixed_avg("value").alias("average"))


def rules_on_windows(windows: DataFrame) -> DataFrame:
    """Each rule's statistic and breach flag on its windows, with the
    window index ``w_idx`` (window start / period)."""
    rules = F.broadcast(alarm_rules(windows.sparkSession))
    g = windows.join(rules, ["metric", "period_s"])
    g = g.withColumn("value", F.when(F.col("stat") == "Average", F.col("average")).otherwise(F.col("total")))
    g = g.withColumn("breach", F.when(F.col("comparison") == "GreaterThanThreshold",
                                      F.col("value") > F.col("threshold"))
                     .otherwise(F.col("value") < F.col("threshold")))
    return g.withColumn("w_idx", F.floor(F.unix_seconds("window_start") / F.col("period_s")).cast("long"))


def alarm_evaluation(metrics: DataFrame) -> DataFrame:
    """W11/Z3 batch twin: per alarm rule and window, the statistic, the
    breach flag, and ``in_alarm`` when the last ``evaluation_periods``
    consecutive windows all breached (a window without data breaks the
    run)."""
    g = rules_on_windows(rule_windows(metrics))
    # Consecutive breaching windows (gaps and islands): among breaching
    # windows, w_idx - row_number is constant along a run of adjacent
    # windows; the position inside that run is the run length so far.
    # Each alarm has at most span/period windows, independent of data size.
    b = g.filter("breach").withColumn(
        "_grp", F.col("w_idx") - F.row_number().over(Window.partitionBy("alarm").orderBy("w_idx")))
    b = b.withColumn("run_length", F.row_number().over(Window.partitionBy("alarm", "_grp").orderBy("w_idx")))
    g = g.join(b.select("alarm", "w_idx", "run_length"), ["alarm", "w_idx"], "left")
    in_alarm = F.coalesce(F.col("run_length"), F.lit(0)) >= F.col("evaluation_periods")
    return g.select("alarm", "metric", "window_start", "value", "breach",
                    F.coalesce("run_length", F.lit(0)).alias("run_length"), in_alarm.alias("in_alarm"))


def llm_cost_rollup(calls: DataFrame) -> DataFrame:
    """LLM cost summed per hour and per day, as the two grouping sets of
    one aggregate: the calls are read and shuffled once for both. Calls
    without a time are summed in a window of their own (null start)."""
    starts = {label: window_start(F.col("ts"), F.lit(secs)) for label, secs in (("hour", 3600), ("day", 86400))}
    hourly = F.grouping("hour") == 0
    g = calls.withColumns(starts).groupingSets([["hour"], ["day"]], "hour", "day").agg(
        F.when(hourly, "hour").otherwise("day").alias("period"),
        F.when(hourly, F.col("hour")).otherwise(F.col("day")).alias("window_start"),
        fixed_sum("cost_estimate_usd").alias("cost_usd"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.count("*").alias("calls"))
    return g.drop("hour", "day")


def threshold_flags(calls: DataFrame) -> DataFrame:
    """Per-call tokens > 5000, cost > $0.10, latency > 10 s."""
    return calls.select("ts", "request_id", "model",
                        (F.col("total_tokens") > TOKENS_PER_REQUEST).alias("tokens_flag"),
                        (F.col("cost_estimate_usd") > COST_PER_REQUEST).alias("cost_flag"),
                        (F.col("duration") > LATENCY_SECONDS).alias("latency_flag"))


def span_pairs(starts: DataFrame, ends: DataFrame, max_duration: str) -> DataFrame:
    """The span rule of both twins: a start (``sid, start_ts``) with each end (``eid, end_ts, event_type``) of its
    request that comes within ``max_duration``; a start without one stays, with null end, duration and success."""
    j = starts.join(ends, F.expr(
        f"sid = eid AND end_ts >= start_ts AND end_ts <= start_ts + interval {max_duration}"), "left")
    return j.select(F.col("sid").alias("request_id"), "start_ts", "end_ts",
                    ((F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1e6).alias("duration_s"),
                    (F.col("event_type") == "request_end").alias("success"))


def span_sides(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Starts and ends of the requests in a log."""
    starts = log.filter(F.col("event_type") == "request_start").select(F.col("request_id").alias("sid"), F.col("ts").alias("start_ts"))
    ends = log.filter(F.col("event_type").isin("request_end", "request_error")).select(
        F.col("request_id").alias("eid"), F.col("ts").alias("end_ts"), "event_type")
    return starts, ends


def request_spans(log: DataFrame, max_duration: str = "1 hour") -> DataFrame:
    """Z5 batch twin: each request_start with its request_end/request_error within ``max_duration`` (success = it
    was an end), or with nulls if none came in time."""
    return span_pairs(*span_sides(log), max_duration)


def cache_rollup(metrics: DataFrame, period_s: int = 300) -> DataFrame:
    """Hits, misses, hit rate and mean latency per window."""
    m = metrics.filter(F.col("metric").isin("CacheHits", "CacheMisses", "CacheLatency"))
    m = m.withColumn("window_start", window_start(F.col("ts"), F.lit(period_s)))
    g = m.groupBy("window_start").agg(
        F.count_if(F.col("metric") == "CacheHits").alias("hits"),
        F.count_if(F.col("metric") == "CacheMisses").alias("misses"),
        fixed_avg(F.when(F.col("metric") == "CacheLatency", F.col("value"))).alias("avg_latency_s"))
    return g.withColumn("hit_rate", F.col("hits") / (F.col("hits") + F.col("misses")))


def metrics_from_bodies(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """Metric rows implied by JSON response bodies — one LLM usage set
    when ``token_usage`` is present, one media set per item of ``media``,
    one cache set when ``cache_info`` is present."""
    v = bodies.select(F.try_parse_json(F.col(body_col)).alias("b"))

    def g(path, typ="double"):
        return F.try_variant_get(F.col("b"), path, typ)

    dur = F.coalesce(g("$.duration"), F.lit(0.0))
    pt = F.coalesce(g("$.token_usage.prompt_tokens", "long"), F.lit(0))
    ct = F.coalesce(g("$.token_usage.completion_tokens", "long"), F.lit(0))
    llm = v.filter(g("$.token_usage", "variant").isNotNull()).select(F.explode(F.array(
        _m("LLMLatency", dur, "Seconds"), _m("PromptTokens", pt, "Count"),
        _m("CompletionTokens", ct, "Count"), _m("TotalTokens", pt + ct, "Count"))).alias("m"))
    items = v.select(dur.alias("dur"), F.explode(g("$.media", "array<variant>")).alias("item"))
    itype = F.try_variant_get(F.col("item"), "$.type", "string")
    size = F.coalesce(F.try_variant_get(F.col("item"), "$.metadata.size_bytes", "double"), F.lit(0.0))
    media = items.select(F.explode(F.array(
        _m("MediaProcessingTime", F.col("dur"), "Seconds"), _m("MediaSize", size, "Bytes"),
        _m(F.concat(F.upper(F.substring(itype, 1, 1)), F.lower(F.substring(itype, 2, 1 << 20)), F.lit("Count")),
           1, "Count"))).alias("m"))
    hit = g("$.cache_info.hit", "boolean")
    op = F.when(hit, "Hit").otherwise("Miss")
    cache = v.filter(g("$.cache_info", "variant").isNotNull()).select(F.filter(F.array(
        _m("CacheLatency", F.coalesce(g("$.cache_info.duration"), F.lit(0.0)), "Seconds"),
        _m(F.concat(F.lit("Cache"), op, F.lit("s")), 1, "Count"),
        F.when(op == "Miss", _m("CacheMisses", 1, "Count"))), lambda x: x.isNotNull()).alias("ms"))
    cache = cache.select(F.explode("ms").alias("m"))
    return (llm.unionByName(media).unionByName(cache)
            .select("m.metric", "m.value", "m.unit"))
