"""Per-group first-k / dedupe helpers.

``row_number() <= k`` over a window is planned as a WindowGroupLimit: each
map task keeps at most k rows per group before the shuffle, so even a group
holding a large share of all rows sends only k rows to its reducer. The
nested variants collect only those k rows, never a whole group.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int,
            rank_col: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows of each ``keys`` group in ``order``; adds a
    1-based ``rank_col``."""
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def rows_per_key(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Row count per ``keys`` group as a partial aggregate. It counts the
    JSON of the whole row (never null, but not provably so to the
    optimizer), so it is neither rewritten to ``count(1)`` nor does column
    pruning trim ``df``. When ``df`` ends in an exchange that another branch
    also reads (e.g. ``first_k`` over the same rows), Spark then reuses that
    exchange instead of recomputing ``df``. Use it on small, already
    reduced rows."""
    return df.groupBy(*keys).agg(F.count(F.to_json(F.struct(*df.columns))).alias(name))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First-wins dedupe — one row per ``keys`` group, the first in
    ``order``."""
    return first_k(df, keys, order, 1, "_rn").drop("_rn")


def nest_ordered(df: DataFrame, keys: Sequence[str], ord_col: str,
                 fields: Sequence[str], name: str) -> DataFrame:
    """Re-nest rows into one ordered ``array<struct>`` per group. Callers
    bound the group first (first_k), so the array size is capped by k."""
    packed = F.struct(F.col(ord_col).alias("_o"), *[F.col(f) for f in fields])
    arr = F.array_sort(F.collect_list(packed))
    return df.groupBy(*keys).agg(
        F.transform(arr, lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias(name))
