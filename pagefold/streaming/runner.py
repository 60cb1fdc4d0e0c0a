"""Run a Structured Streaming query to completion over landed files.

``land`` writes input rows as slices of files (in event-time order, several
slices so the stream sees several micro-batches) under the shared checkpoint
folder; ``arrivals`` reads them as a stream, a slice a micro-batch;
``drain`` runs a stream with ``Trigger.AvailableNow`` into a
``foreachBatch`` sink that overwrites ``batch=<id>`` (so a retried batch
never duplicates rows) and returns what was written — the latest row per
key for update-mode streams.
"""

from __future__ import annotations

import os
import uuid
from typing import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _dir(df: DataFrame, kind: str, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(df.sparkSession), kind, f"{name}-{uuid.uuid4().hex}")


#: Rows of a landed file, if every slice has as many.
FILE_ROWS = 100_000


def land(df: DataFrame, name: str, n_files: int = 4, order_by: str | None = None,
         fmt: str = "parquet", file_rows: int = FILE_ROWS) -> str:
    """Write ``df`` as ``n_files`` slices cut at quantiles of ``order_by``
    (nulls first). The slices are written one after another, so file
    modification times (the file source's arrival order) follow event time,
    as files arriving from a live feed would. Every slice has the same number
    of files: one, or as many of ``file_rows`` as the smallest slice fills, so
    large slices are written and read by many tasks. Rows are dealt round
    robin, which leaves none of the files empty while a slice has more rows
    than ``file_rows`` a file and is read by fewer tasks than that. Returns
    the folder."""
    path = _dir(df, "landing", name)
    if not order_by:
        df.repartition(n_files).write.format(fmt).save(path)
        return path
    whole = materialize_slices(df)
    key = F.unix_micros(order_by) if whole.schema[order_by].dataType.typeName() == "timestamp" else F.col(order_by)
    at = [i / n_files for i in range(1, n_files)]
    cuts = whole.agg(F.percentile_approx(key, at, 10_000).alias("q")).first()["q"] if at else None
    behind = [F.when(key > c, 1).otherwise(0) for c in cuts or []]
    sliced = whole.withColumn("_slice", sum(behind, F.lit(0)))
    sizes = {r["_slice"]: r["count"] for r in sliced.groupBy("_slice").count().collect()}     # a row a slice
    files = max(1, min(sizes.get(i, 0) for i in range(n_files)) // file_rows)
    for i in range(n_files):
        part = sliced.filter(F.col("_slice") == i).drop("_slice")
        part = part.coalesce(1) if files == 1 else part.repartition(files)
        part.sortWithinPartitions(order_by).write.mode("append").format(fmt).save(path)
    return path


def materialize_slices(df: DataFrame) -> DataFrame:
    """Compute the rows once (the sequential writes re-read them)."""
    from ..session import materialize
    return materialize(df, "slices")


def arrivals(spark: SparkSession, path: str, schema: str, n_files: int = 4) -> DataFrame:
    """The slices that ``land`` wrote as Parquet, as a stream with a slice a micro-batch."""
    files = len(spark.read.schema(schema).parquet(path).inputFiles())
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, files // n_files)).parquet(path)


def drain(stream: DataFrame, name: str, output_mode: str = "append",
          keys: Sequence[str] | None = None) -> DataFrame:
    spark = stream.sparkSession
    out = _dir(stream, "sink", name)
    chk = _dir(stream, "chk", name)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    q = (stream.writeStream.outputMode(output_mode).foreachBatch(write_batch)
         .option("checkpointLocation", chk).trigger(availableNow=True).start())
    q.awaitTermination()
    try:
        # read through Spark (not the local file system): the folder lives on
        # the shared checkpoint storage
        res = spark.read.parquet(out)
    except AnalysisException:        # no batch wrote anything: the folder does not exist
        return spark.createDataFrame([], stream.schema)
    if keys:
        rest = [c for c in res.columns if c not in keys and c != "batch"]
        latest = res.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
        return latest.select(*keys, *[F.col("_r." + c).alias(c) for c in rest])
    return res.drop("batch")
