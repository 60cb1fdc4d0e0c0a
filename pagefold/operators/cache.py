"""TTL result cache as a keyed table (S11, S12, J4, Z4 batch twin).

Cache rows: ``url, type, data (JSON text), expires_at, created_at`` (epoch
seconds). Lookups are a left join on (url, type); upserts keep the latest
write per key with ``max_by`` (a partial aggregate, no window over a hot
key); deletes are anti joins. ``now`` is a job parameter so a run is
reproducible.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

CACHE_DDL = "url string, type string, data string, expires_at bigint, created_at bigint"


def is_valid(expires_at, now: int, boundary: str = "root"):
    """Q7: root treats a row as live iff ``expires_at > now``; the service iff
    ``ttl >= now``."""
    e = F.col(expires_at) if isinstance(expires_at, str) else expires_at
    return e > F.lit(now) if boundary == "root" else e >= F.lit(now)


def _found(requests: DataFrame, cache: DataFrame) -> DataFrame:
    c = cache.select("url", "type", F.col("data").alias("_data"), F.col("expires_at").alias("_exp"))
    return requests.join(c, ["url", "type"], "left")


def _status(now: int, boundary: str):
    return (F.when(F.col("_exp").isNull(), "miss").when(is_valid("_exp", now, boundary), "hit")
            .otherwise("expired"))


def lookup(requests: DataFrame, cache: DataFrame, now: int, boundary: str = "root") -> DataFrame:
    """Per request (url, type): status hit / expired / miss and the
    cached data on a hit."""
    return _found(requests, cache).withColumn("cache_status", _status(now, boundary)).withColumn(
        "cached_data", F.when(is_valid("_exp", now, boundary), F.col("_data"))).drop("_data", "_exp")


def lookup_both(requests: DataFrame, cache: DataFrame, now: int) -> DataFrame:
    """The status under either boundary, and root's cached data, from one join."""
    return _found(requests, cache).withColumns({
        "root_status": _status(now, "root"), "service_status": _status(now, "service"),
        "cached_data": F.when(is_valid("_exp", now, "root"), F.col("_data"))}).drop("_data", "_exp")


def upsert(cache: DataFrame, writes: DataFrame) -> DataFrame:
    """Last write wins per (url, type) — by created_at, and a new write
    beats an existing row with the same created_at."""
    old = cache.select(*cache.columns, F.lit(0).alias("_gen"))
    new = writes.select(*cache.columns, F.lit(1).alias("_gen"))
    both = old.unionByName(new)
    g = both.groupBy("url", "type").agg(F.max_by(
        F.struct("data", "expires_at", "created_at"), F.struct("created_at", "_gen")).alias("r"))
    return g.select("url", "type", "r.data", "r.expires_at", "r.created_at")


def delete(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """S12 delete: drop the given (url, type) keys."""
    return cache.join(keys.select("url", "type"), ["url", "type"], "left_anti")


def purge_expired(cache: DataFrame, now: int, boundary: str = "root") -> DataFrame:
    """The root cache deletes an expired row when it is read; as a batch
    rewrite this keeps only live rows."""
    return cache.filter(is_valid("expires_at", now, boundary))


def get_or_set(requests: DataFrame, cache: DataFrame, getter: Callable[[DataFrame], DataFrame],
               now: int, ttl: int, boundary: str = "root") -> tuple[DataFrame, DataFrame]:
    """Hits are answered from the cache; misses (and expired rows)
    are computed by ``getter(misses) -> (url, type, data)`` and written
    back. Returns (answers with ``hit`` flag, new cache table). The getter
    gets each missing key once, and its output is stored before it feeds
    both results, so it runs once; repeated requests share its answer."""
    looked = lookup(requests, cache, now, boundary)
    hits = looked.filter(F.col("cache_status") == "hit").select(
        "url", "type", F.col("cached_data").alias("data"), F.lit(True).alias("hit"))
    missed = looked.filter(F.col("cache_status") != "hit").select("url", "type")
    computed = materialize(getter(missed.distinct()).select("url", "type", "data"), "cache-computed")
    answers = hits.unionByName(missed.join(computed, ["url", "type"]).select(
        "url", "type", "data", F.lit(False).alias("hit")))
    writes = computed.select("url", "type", "data", F.lit(now + ttl).cast("long").alias("expires_at"),
                             F.lit(now).cast("long").alias("created_at"))
    return answers, upsert(purge_expired(cache, now, boundary), writes)
