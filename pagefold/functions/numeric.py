"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_places(c, places: int = 6) -> Column:
    """Round half away from zero at ``places`` decimals as ``round(x * 10^p)
    / 10^p`` on doubles. Rounding the scaled double (rather than its exact
    binary expansion) gives the same result as other engines that round
    this way, so reports compare stably."""
    col = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** places)
    return F.round(col * scale, 0) / scale


FIXED = "decimal(38,9)"


def fixed_sum(c) -> Column:
    """Exact sum of a metric in fixed point (nano units, DECIMAL(38,9)),
    returned as double. Unlike a floating-point sum it does not depend on
    how rows are partitioned or ordered, so reruns and engines agree."""
    col = F.col(c) if isinstance(c, str) else c
    return F.sum(col.cast(FIXED)).cast("double")


def fixed_avg(c, places: int = 6) -> Column:
    """Average of a metric from its exact fixed-point sum, rounded half-up
    at ``places`` decimals, as double."""
    col = F.col(c) if isinstance(c, str) else c
    scale = 10 ** places
    exact = F.try_divide(F.sum(col.cast(FIXED)) * F.lit(scale).cast("decimal(20,0)"), F.count(col))
    return (F.round(exact, 0) / F.lit(scale)).cast("double")


def utc_instant(c) -> Column:
    """A TIMESTAMP_NTZ wall-clock value read as UTC, whatever the session
    time zone (a plain cast would use the session zone)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.concat(col.cast("string"), F.lit("Z")).cast("timestamp")
