"""Input sources: crawl pages, URL seed lists, search-result harvests and
binary media files (S1, S3, S4, S6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str, status_col: str | None = None) -> DataFrame:
    """The crawl corpus ``(page_id, url, html)``; when the crawl records
    an HTTP status, only 2xx pages are kept (the reference raises on
    non-2xx). Only the needed columns are read from Parquet."""
    df = spark.read.parquet(path)
    cols = ["page_id", "url", "html"]
    if status_col:
        df = df.filter((F.col(status_col) >= 200) & (F.col(status_col) < 300))
    return df.select(*cols)


def read_seed_lists(spark: SparkSession, path: str) -> DataFrame:
    """S3: files each holding a JSON array of URLs -> one row per URL with
    its file and position (multi-line JSON; the array is the document)."""
    raw = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), F.from_json("value", "array<string>").alias("urls"))
    return raw.select("file", F.posexplode("urls").alias("pos", "url"))


def seed_harvest(results: DataFrame, max_total: int = 200, seed: int = 42) -> DataFrame:
    """Harvest seed URLs from search results ``(query_rank,
    result_rank, href)``: keep ``http*`` hrefs without "example"/"list",
    distinct; queries are consumed in order until at least ``max_total``
    distinct URLs were seen; then ``max_total`` of them in random order
    (seeded). The cap is the operator's parameter, as in the reference."""
    h = F.col("href")
    ok = results.filter(h.isNotNull() & h.startswith("http") & ~h.contains("example") & ~h.contains("list"))
    first = ok.groupBy("href").agg(F.min("query_rank").alias("query_rank"))
    per_query = first.groupBy("query_rank").agg(F.count("*").alias("new_urls"))   # one row per query
    running = per_query.withColumn(
        "seen", F.sum("new_urls").over(Window.orderBy("query_rank").rowsBetween(Window.unboundedPreceding, 0)))
    before = F.coalesce(F.lag("seen").over(Window.orderBy("query_rank")), F.lit(0))
    used = running.withColumn("seen_before", before).filter(F.col("seen_before") < max_total).select("query_rank")
    picked = first.join(used, "query_rank")       # one row per search query; AQE sizes the join
    return picked.orderBy(F.rand(seed)).limit(max_total).select(F.col("href").alias("url"))


# Leading bytes of the image formats the reference opens.
_MAGIC = [("89504E47", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif"), ("52494646", "webp"), ("424D", "bmp")]


def image_metadata(spark: SparkSession, path: str) -> DataFrame:
    """S6/F8 input: width, height, channels/mode, format and byte size of
    every decodable image file under ``path``; undecodable files drop out
    (``dropInvalid``), as failed opens do in the reference."""
    # the two sources spell local file URIs differently (file:///x vs file:/x)
    def norm(c):
        return F.regexp_replace(c, "^file:///", "file:/")

    img = (spark.read.format("image").option("dropInvalid", True).load(path)
           .select(norm(F.col("image.origin")).alias("path"), F.col("image.width").alias("width"),
                   F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels")))
    files = spark.read.format("binaryFile").load(path).select(
        norm(F.col("path")).alias("path"), F.col("length").alias("size_bytes"),
        F.upper(F.hex(F.substring("content", 1, 4))).alias("magic"))
    fmt = None
    for prefix, name in _MAGIC:
        cond = F.col("magic").startswith(prefix)
        fmt = F.when(cond, name) if fmt is None else fmt.when(cond, name)
    mode = F.when(F.col("channels") == 1, "L").when(F.col("channels") == 3, "RGB").when(
        F.col("channels") == 4, "RGBA")
    return img.join(files, "path").select("path", "width", "height", mode.alias("mode"),
                                         fmt.alias("format"), "size_bytes")
