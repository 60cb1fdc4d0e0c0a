"""Connected components by alternating large and small stars, each round stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def _digest(edges: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes: equal when a round moved nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node of ``edges`` (``a``, ``b``), by long ids.

    A large star hangs a node's larger neighbours on the smallest node it
    knows, a small star does so with its smaller ones; the rounds end when
    nothing moves, after a number of rounds that grows with the logarithm of
    the graph. Minima are summed before the shuffle, so the centre of a large
    star costs no more than its edges.
    """
    now = store(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _digest(now)
    while seen[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a")
        moved = (small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
                 .union(lowest.select("a", F.col("m").alias("b"))).distinct())
        now = store(moved, "edges")
        before, seen = seen, _digest(now)
        if seen == before:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select("b", "b").distinct())


def contract(links: DataFrame, grouped: DataFrame | None) -> DataFrame:
    """Components after more ``links``, given the ``grouped`` ones before.

    The links are drawn between components first, where all that join the
    same two are one edge; only that smaller graph is searched.
    """
    if grouped is None:
        return store(components(links), "components")
    named = links
    for end in "ab":
        of = grouped.select(F.col("node").alias(end), F.col("component").alias("c"))
        named = named.join(of, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    joined = store(components(named), "components")
    moved = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = grouped.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    fresh = joined.join(grouped.select("node"), "node", "left_anti")
    return store(old.union(fresh.select("node", "component")), "components")
