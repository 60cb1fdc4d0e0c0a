"""Keyed tables that are changed bucket by bucket.

A table is Parquet partitioned by ``bucket``, a hash of its key columns. A
change reads and rewrites only the buckets that hold one of its keys
(dynamic partition overwrite); the files of all others stay as they are, so
the cost of an upsert or delete follows the change, not the table. Choose
the number of buckets so that one fits a task (keys are hashed, so buckets
are even), and keep it for the life of the table.

One writer at a time. The new rows of the touched buckets are stored before
any old file is replaced, so a write that dies half-way can be made again
from them.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: Every bucket that is written holds one row with this mark, so one that loses its last row is overwritten, too.
MARK = "_mark"


@dataclass(frozen=True)
class BucketTable:
    """A table at ``path``, keyed by ``keys``, in ``buckets`` buckets. Null keys have a bucket like others."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, marked: DataFrame, mode: str) -> None:
        # rebalanced, so a bucket is written by one task, or by several if it has grown large
        out = rows.withColumns({"bucket": self.bucket(), MARK: F.lit(False)}).unionByName(
            marked.withColumn(MARK, F.lit(True)), allowMissingColumns=True)
        (out.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", mode)
         .partitionBy("bucket").parquet(self.path))

    def create(self, rows: DataFrame) -> "BucketTable":
        """Write the whole table."""
        self._write(rows, self.spark.range(self.buckets).select(F.col("id").cast("int").alias("bucket")), "static")
        return self

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows, of all buckets or of those numbered (other folders are not listed as input)."""
        rows = self.spark.read.parquet(self.path)
        if only is not None:
            rows = rows.filter(F.col("bucket").isin(only))
        return rows.filter(~F.col(MARK)).drop("bucket", MARK)

    def touched(self, changes: DataFrame) -> list[int]:
        """Numbers of the buckets that hold a key of ``changes``; at most ``buckets`` of them."""
        return sorted(r[0] for r in changes.select(self.bucket().alias("b")).distinct().collect())

    def change(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the touched buckets by ``merge(their rows, changes)`` and return their numbers.

        ``merge`` may drop, alter and add rows of keys in ``changes``. Changes
        without rows touch nothing. The changes are read twice; store them
        first if they are dear or not repeatable.
        """
        numbers = self.touched(changes)
        if numbers:
            old = self.read(numbers)
            new = materialize(merge(old, changes).select(*old.columns), f"{os.path.basename(self.path)}-rewrite")
            marks = self.spark.range(self.buckets).select(F.col("id").cast("int").alias("bucket")).filter(F.col("bucket").isin(numbers))
            self._write(new, marks, "dynamic")
            self.spark.catalog.refreshByPath(self.path)
        return numbers


def insert_absent(keys: tuple[str, ...]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge that adds rows whose key is not there yet (content-addressed stores: one key, one content)."""
    return lambda old, new: old.unionByName(
        new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti").select(*old.columns))
