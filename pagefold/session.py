"""Spark session helpers.

The session settings here are the ones the library relies on: ANSI mode
(Spark 4 default), AQE with skew-join splitting, Arrow for Python
workers with byte-bounded batches, UTC session time zone and no web UI.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "pagefold") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join(
        p for p in (repo, os.environ.get("PYTHONPATH", "")) if p)
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # small local inputs: keep CPU-heavy per-row stages (regex ladders on
        # page text) spread over the cores instead of coalesced into one task
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # HTML rows are large: cap each Arrow batch sent to the parser by
        # bytes, not only by the default 10,000 rows
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PAGEFOLD_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the operator sets this to a shared file system path and we
    only read it; there, executors cannot see a folder of the driver's own
    machine, so an unset path is an error. Only a local master (tests) gets a
    fresh scratch folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="pagefold-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back. Cuts lineage (a lost executor re-reads files instead of re-parsing
    HTML) and lets several branches of one plan share one computation."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt out to tasks of about ``rows`` rows each. For inputs whose rows become much larger than they are
    stored, so that splits by bytes would give a whole table to one task."""
    tasks = -(-df.count() // rows)
    return df.repartition(tasks) if tasks > 1 else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def materialize_elements(elements: DataFrame, name: str = "elements") -> DataFrame:
    """Write an element table for reuse, each file sorted by (tag, page_id,
    node_id): Parquet row-group statistics on ``tag`` then let the many
    tag-filtered reads (links, media, headings...) skip row groups. The
    sort is within partitions only — no shuffle."""
    return materialize(elements.sortWithinPartitions("tag", "page_id", "node_id"), name)
