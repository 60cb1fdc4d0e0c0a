"""Per-key state machines (Z1 token bucket, Z4 TTL cache) and their twins."""

import pytest

from pagefold.streaming.state_machines import TokenBucket, TtlCache


def test_token_bucket_reference_cases():
    tb = TokenBucket(rpm=60, burst=10)
    state, allowed, tokens, _ = tb.step(None, 1000.0)
    assert allowed and tokens == 10 and state == (9, 1000.0)
    _, _, tokens, _ = tb.step((5.0, 999.0), 1000.0)
    assert 5.0 < tokens < 6.1
    _, _, tokens, _ = tb.step((5.0, 900.0), 1000.0)
    assert tokens == 10
    _, allowed, _, _ = tb.step((0.0, 1000.0), 1000.0)
    assert allowed is False
    st, allowed, _, retry = tb.step((0.5, 1000.0), 1000.0)
    assert allowed is False and retry == pytest.approx(0.5) and st == (0.5, 1000.0)


def test_ttl_cache_machine():
    c = TtlCache(100)
    s, hit = c.step(None, 0.0)
    assert not hit and s == (100.0,)
    s, hit = c.step(s, 50.0)
    assert hit
    s, hit = c.step(s, 100.0)          # root boundary: expires_at > now
    assert not hit and s == (200.0,)
    assert TtlCache(100, "service").step((100.0,), 100.0)[1] is True


def test_throttle_batch_equals_stream(spark):
    import __spark_entry__ as E
    q = E.queries()
    sf = "/root/testdata/sf0.001"
    a = sorted(map(tuple, q["z1_throttle_batch"](spark, sf).collect()))
    b = sorted(map(tuple, q["z1_throttle_stream"](spark, sf).collect()))
    assert a == b and len(a) > 0


class Held:
    """List and value state of one key in memory, with the timers asked for."""

    def __init__(self):
        self.items, self.value, self.timers, self.reads = [], None, [], 0

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        outer = self

        class Value:
            exists = staticmethod(lambda: outer.value is not None)
            get = staticmethod(lambda: outer.value)
            update = staticmethod(lambda v: setattr(outer, "value", v))
        return Value

    def registerTimer(self, at):
        self.timers.append(at)

    def appendList(self, items):
        self.items += items

    def get(self):
        self.reads += 1
        return iter(self.items)

    def put(self, items):
        self.items = list(items)

    def clear(self):
        self.items = []


def test_alarm_windows_are_read_once_a_batch_not_once_a_timer():
    import pandas as pd

    from pagefold.streaming.operators import AlarmRuns

    held, runs = Held(), AlarmRuns()
    runs.init(held)
    rows = pd.DataFrame({"w_idx": range(300), "metric": "m", "start_us": 0, "end_ms": [60_000 * (i + 1) for i in range(300)],
                         "value": 1.0, "breach": True, "n": 3})
    list(runs.handleInputRows(("a",), iter([rows[::-1], rows[5:6].assign(breach=False)]), None))
    assert held.timers == [60_000]

    class Watermark:
        getCurrentWatermarkInMs = staticmethod(lambda: 60_000 * 200)
    out = [tuple(r) for f in runs.handleExpiredTimer(("a",), Watermark, None) for r in f.itertuples(index=False)]
    assert held.reads == 1 and len(out) == 200 and len(held.items) == 100
    assert [r[5] for r in out] == [1, 2, 3, 4, 5, 0, *range(1, 195)] and out[2][6] and not out[1][6]    # the later row of index 5 counts
    assert held.timers == [60_000, 60_000 * 201] and held.value == (199, 194)


def test_landed_slices_are_of_many_files_and_in_order(spark):
    from pyspark.sql import functions as F

    from pagefold.streaming.runner import arrivals, land

    df = spark.range(8000).select("id", F.when(F.col("id") > 9, F.timestamp_seconds("id")).alias("ts"))
    path = land(df.repartition(5, "id"), "many", 4, order_by="ts", file_rows=200)
    assert len(spark.read.parquet(path).inputFiles()) >= 4 * 5
    seen = []

    def batch(rows, i):
        seen.append(rows.agg(F.count("*"), F.min("ts"), F.max("ts")).first())
    from pagefold.session import ensure_checkpoint_dir
    (arrivals(spark, path, "id long, ts timestamp").writeStream.foreachBatch(batch).trigger(availableNow=True)
     .option("checkpointLocation", f"{ensure_checkpoint_dir(spark)}/many-{spark.sparkContext.startTime}").start().awaitTermination())
    assert sum(n for n, *_ in seen) == 8000 and len(seen) == 4
    assert all(a[2] < b[1] for a, b in zip(seen, seen[1:]))
    few = land(df.limit(10), "few", 4, order_by="id")
    assert spark.read.parquet(few).count() == 10 and len(spark.read.parquet(few).inputFiles()) == 4
