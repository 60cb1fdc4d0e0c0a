"""Structured Streaming operators (Z1-Z6) and their batch twins.

* Z1 throttle and Z4 TTL cache: per-key state machines
  (``applyInPandasWithState``; batch twin: sorted ``mapInPandas`` scan).
* Z2 windowed metrics: event-time tumbling windows with a watermark,
  append mode (built-in streaming aggregation, partial-aggregated).
* Z3 alarms: consecutive-breach state per alarm over metric windows in any
  order, held by event-time timers (``transformWithStateInPandas``).
* Z5 request spans: stream-stream left outer join with watermarks on both
  sides and an event-time range condition, so join state is bounded and a
  start without an end comes out when it is evicted.
* Z6 incremental pages: ``foreachBatch`` runs a batch plan per micro-batch.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.numeric import fixed_avg, fixed_sum
from ..operators.metrics import metrics_from_log, rules_on_windows, span_pairs, span_sides
from .state_machines import TokenBucket, TtlCache, scan_sorted

THROTTLE_OUT = "user_id long, event_id long, allowed boolean, tokens double, retry_after double"
CACHE_OUT = "cache_key string, event_id long, hit boolean"


# ------------------------------------------------------------------ Z1
def _seconds(ts: str):
    return (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t")


def _throttle_out(df: DataFrame) -> str:
    return THROTTLE_OUT.replace("user_id long", f"user_id {df.schema['user_id'].dataType.simpleString()}")


def _key(key):
    """H1: the limiter key is a column name or any Column expression (e.g.
    ``coalesce(api_key, client_host)``)."""
    return F.col(key) if isinstance(key, str) else key


def throttle_batch(events: DataFrame, key="user_id", ts: str = "ts", rpm: float = 60,
                   burst: float = 10) -> DataFrame:
    """Z1 batch twin: token bucket per key over event time."""
    tb = TokenBucket(rpm, burst)
    df = events.select(_key(key).alias("user_id"), "event_id", _seconds(ts))
    df = df.repartition("user_id").sortWithinPartitions("user_id", "t", "event_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from scan_sorted(frames, "user_id", "t", tb, lambda r, s, res: {
            "user_id": r.user_id, "event_id": r.event_id, "allowed": res[0], "tokens": res[1],
            "retry_after": res[2]})
    return df.mapInPandas(run, _throttle_out(df))


def throttle_stream(events: DataFrame, key="user_id", ts: str = "ts", rpm: float = 60,
                    burst: float = 10) -> DataFrame:
    """The token bucket as streaming per-key state."""
    tb = TokenBucket(rpm, burst)
    df = events.select(_key(key).alias("user_id"), "event_id", _seconds(ts))

    def fn(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # a key has few rows a batch: what one frame costs decides, so there are no more frames than are needed
        rows = [*frames]
        rows = rows[0] if len(rows) == 1 else pd.concat(rows)
        t, ids = rows["t"].to_numpy(), rows["event_id"].to_numpy()
        order = np.lexsort((ids, t))
        st = tuple(state.get) if state.exists else None
        out = []
        for x in t[order].tolist():
            st, *res = tb.step(st, x)
            out.append(res)
        if st is not None:
            state.update(st)
        allowed, tokens, retry = zip(*out)
        yield pd.DataFrame({"user_id": [k[0]] * len(out), "event_id": ids[order], "allowed": allowed, "tokens": tokens,
                            "retry_after": retry})
    return df.groupBy("user_id").applyInPandasWithState(
        fn, _throttle_out(df), "tokens double, last_update double", "append", GroupStateTimeout.NoTimeout)


# ------------------------------------------------------------------ Z4
def ttl_cache_batch(requests: DataFrame, key: str, ts: str, ttl_seconds: float,
                    boundary: str = "root") -> DataFrame:
    """Z4 batch twin: hit/miss per request against a TTL cache keyed by
    ``key``."""
    m = TtlCache(ttl_seconds, boundary)
    df = requests.select(F.col(key).cast("string").alias("cache_key"), "event_id", _seconds(ts))
    df = df.repartition("cache_key").sortWithinPartitions("cache_key", "t", "event_id")

    def run(frames):
        yield from scan_sorted(frames, "cache_key", "t", m, lambda r, s, res: {
            "cache_key": r.cache_key, "event_id": r.event_id, "hit": res[0]})
    return df.mapInPandas(run, CACHE_OUT)


def ttl_cache_stream(requests: DataFrame, key: str, ts: str, ttl_seconds: float,
                     boundary: str = "root") -> DataFrame:
    """The TTL cache as streaming state; an entry is dropped by an
    event-time timeout once it expires, so state stays bounded."""
    m = TtlCache(ttl_seconds, boundary)
    df = requests.select(F.col(key).cast("string").alias("cache_key"), "event_id", _seconds(ts),
                         F.col(ts).alias("ts")).withWatermark("ts", f"{int(ttl_seconds)} seconds")

    def fn(k, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
        st = tuple(state.get) if state.exists else None
        out = []
        for r in rows.itertuples(index=False):
            st, hit = m.step(st, r.t)
            out.append({"cache_key": k[0], "event_id": r.event_id, "hit": hit})
        state.update(st)
        state.setTimeoutTimestamp(int(st[0] * 1000) + 1)
        yield pd.DataFrame(out)
    return df.groupBy("cache_key").applyInPandasWithState(
        fn, CACHE_OUT, "expires_at double", "append", GroupStateTimeout.EventTimeTimeout)


# ------------------------------------------------------------------ Z2
def windowed_metrics_stream(log: DataFrame, period: str = "300 seconds",
                            watermark: str = "10 minutes") -> DataFrame:
    """count/sum/avg per metric and tumbling window, emitted once the
    watermark passes the window end."""
    m = metrics_from_log(log).withWatermark("ts", watermark)
    g = m.groupBy(F.window("ts", period).alias("w"), "metric").agg(
        F.count("*").alias("samples"), fixed_sum("value").alias("total"), fixed_avg("value").alias("average"))
    return g.select(F.col("w.start").alias("window_start"), "metric", "samples", "total", "average")


# ------------------------------------------------------------------ Z3
ALARM_ROWS = "alarm string, metric string, start_us long, value double, breach boolean, run_length int, in_alarm boolean"
#: State with timers lives in this store; a session that runs ``alarm_stream`` must name it as
#: ``spark.sql.streaming.stateStore.providerClass`` when the query starts.
TIMER_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AlarmRuns(StatefulProcessor):
    """Holds an alarm's windows until the watermark has passed their end, then counts breaches in window order.

    The windows that wait are one list, in the order they came; of those of one index the last counts. Only the
    earliest end has a timer: it reads the list once and takes all that is final.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState(
            "waiting", "w_idx long, metric string, start_us long, end_ms long, value double, breach boolean, n int")
        self.last = handle.getValueState("last", "w_idx long, run int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = [(int(r.w_idx), r.metric, int(r.start_us), int(r.end_ms), float(r.value), bool(r.breach), int(r.n))
                for frame in rows for r in frame.itertuples(index=False)]
        if came:
            self.waiting.appendList(came)
            self.handle.registerTimer(min(w[3] for w in came))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = {w[0]: w for w in self.waiting.get()}
        final = sorted(i for i, w in waiting.items() if w[3] <= passed)
        last, run = self.last.get() if self.last.exists() else (None, 0)
        out = []
        for i in final:
            _, metric, start_us, _, value, breach, n = waiting.pop(i)
            run = (run + 1 if last == i - 1 else 1) if breach else 0
            last = i
            out.append((key[0], metric, start_us, value, breach, run, run >= n))
        if out:
            self.last.update((last, run))
            self.waiting.clear()
            if waiting:
                self.waiting.put(list(waiting.values()))
                self.handle.registerTimer(min(w[3] for w in waiting.values()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ALARM_ROWS.split(", ")]) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def alarm_stream(windows: DataFrame, lateness: str = "3 hours") -> DataFrame:
    """Z3: every alarm rule over a stream of metric windows (metric,
    period_s, window_start, total, average), as the batch twin has it: a
    breach run continues only over adjacent windows.

    Windows may come in any order, up to ``lateness`` after the newest one
    seen. Event-time timers hold each until the watermark has passed its
    end, so runs are counted in window order, and state keeps only windows
    that are not final and one run an alarm. Of a window that comes twice
    before it is final the later one counts; one that comes after that is
    dropped, as the watermark has it. Needs ``TIMER_STORE``.
    """
    j = rules_on_windows(windows).withColumn("end_ts", F.timestamp_seconds(F.unix_seconds("window_start") + F.col("period_s")))
    j = j.withWatermark("end_ts", lateness).select(
        "alarm", "metric", F.unix_micros("window_start").alias("start_us"), F.unix_millis("end_ts").alias("end_ms"), "end_ts",
        "w_idx", "value", "breach", F.col("evaluation_periods").alias("n"))
    rows = j.groupBy("alarm").transformWithStateInPandas(
        statefulProcessor=AlarmRuns(), outputStructType=ALARM_ROWS, outputMode="Append", timeMode="EventTime")
    return rows.withColumn("window_start", F.timestamp_micros("start_us")).select(
        "alarm", "metric", "window_start", "value", "breach", "run_length", "in_alarm")


# ------------------------------------------------------------------ Z5
def request_spans_stream(log: DataFrame, watermark: str = "10 minutes",
                         max_duration: str = "1 hour") -> DataFrame:
    """Every request_start with its request_end/request_error within
    ``max_duration``. The left outer join holds a start until the watermark
    has passed its bound; one that got no end by then is emitted with nulls
    as it is evicted, so state is bounded and no request is lost."""
    starts, ends = span_sides(log)
    return span_pairs(starts.withWatermark("start_ts", watermark), ends.withWatermark("end_ts", watermark), max_duration)


# ------------------------------------------------------------------ Z6
def incremental(pages_stream: DataFrame, plan: Callable[[DataFrame], DataFrame], sink: str,
                checkpoint: str):
    """Run a batch ``plan(pages_batch) -> DataFrame`` on every
    micro-batch of new pages; each batch's result overwrites its own
    ``batch=<id>`` folder (idempotent on retry)."""
    import os

    def run(batch: DataFrame, batch_id: int) -> None:
        plan(batch).write.mode("overwrite").parquet(os.path.join(sink, f"batch={batch_id}"))

    return (pages_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
