"""Registry of named queries: name -> (callable(spark, sf_dir) -> DataFrame,
oracle SQL or None). ``__spark_entry__`` exposes it to the driver."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (  # noqa: F401
        queries_classic, queries_company, queries_media, queries_metrics, queries_page, queries_service,
        queries_streaming, queries_assets, queries_stores,
    )
FLAGSHIP = "qa_intelligent"
