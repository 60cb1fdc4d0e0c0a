"""Stored tables shared by repeated runs over the same crawl.

``bucket_page_texts`` writes the crawl's cleaned page texts once, one row
per url, bucketed and sorted by url. The About lookup (J2) then joins the
small link side against it without shuffling the page texts again: Spark
reads the buckets as the join's partitioning and only the link side moves.
Spark keeps a bucketed side's partitioning only when it has at least
``spark.sql.shuffle.partitions`` buckets, so size ``buckets`` to that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.links import page_texts


def bucket_page_texts(corpus: DataFrame, table_name: str, path: str, buckets: int = 64) -> DataFrame:
    """Store ``(about_url, about_title, about_text)`` for every crawled url
    (a recrawl keeps the lowest page_id) as a table bucketed by url at
    ``path``; returns the table."""
    spark = corpus.sparkSession
    texts = page_texts(corpus).groupBy("about_url").agg(
        F.min_by(F.struct("about_title", "about_text"), "about_page_id").alias("t")).select(
        "about_url", "t.about_title", "t.about_text")
    (texts.write.mode("overwrite").bucketBy(buckets, "about_url").sortBy("about_url")
     .option("path", path).saveAsTable(table_name))
    return spark.table(table_name)
