"""Media store, result and log sinks.

Stored media are a Parquet table partitioned by ``media_type`` keyed by a
content address; lookups, downloads and deletes are joins on the key, and
a delete or retention pass rewrites the table (no in-place mutation, so a
lost task simply re-runs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import content_hash, mime_from_name, mime_tables


def url_extension(url) -> Column:
    """``os.path.splitext(url)[1]`` on the whole URL string: the last "."
    suffix of the text after the final "/", leading dots ignored."""
    u = F.col(url) if isinstance(url, str) else url
    seg = F.substring_index(u, "/", -1)
    return F.regexp_extract(seg, r"^\.*[^.].*(\.[^.]*)$", 1)


def store_key(digest: Column, ext: Column, media_type: Column) -> Column:
    """``{type}s/{digest}{ext}``; without an ext .jpg for images and .mp4 otherwise."""
    ext = F.when(ext != "", ext).when(media_type == "image", ".jpg").otherwise(".mp4")
    return F.concat(media_type, F.lit("s/"), digest, ext)


def media_key(content, url, media_type) -> Column:
    """``{type}s/{sha256(content||url)[:32]}{ext}``; ext from the url,
    else .jpg for images and .mp4 otherwise."""
    t = F.col(media_type) if isinstance(media_type, str) else media_type
    return store_key(content_hash(content, url), url_extension(url), t)


def store_media(media: DataFrame, cdn_domain: str, upload_date: str) -> DataFrame:
    """Content-addressed records (one per key) with CDN url and
    metadata. Identical (content, url) pairs collapse to one stored object."""
    keyed = media.withColumn("key", media_key("content", "url", "media_type"))
    first = keyed.dropDuplicates(["key"])
    return first.select(
        "key", "media_type", "content", F.col("url").alias("original_url"),
        F.concat(F.lit(f"https://{cdn_domain}/"), F.col("key")).alias("cdn_url"),
        mime_from_name("key").alias("content_type"),
        F.octet_length("content").alias("size_bytes"), F.lit(upload_date).cast("date").alias("upload_date"))


def write_store(store: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S7 sink: Parquet partitioned by media_type."""
    store.write.mode(mode).partitionBy("media_type").parquet(path)


def url_addressed_name(url, mime) -> Column:
    """``md5(url)`` + the MIME type's extension, else ".bin"."""
    m = F.create_map(*[F.lit(x) for kv in sorted(mime_tables()[1].items()) for x in kv])
    mm = F.col(mime) if isinstance(mime, str) else mime
    u = F.col(url) if isinstance(url, str) else url
    return F.concat(F.md5(u), F.coalesce(F.try_element_at(m, mm), F.lit(".bin")))


def key_of_cdn_url(cdn_url, cdn_domain: str) -> Column:
    """The key is the text after the last "{domain}/"."""
    c = F.col(cdn_url) if isinstance(cdn_url, str) else cdn_url
    return F.substring_index(c, f"{cdn_domain}/", -1)


def metadata_lookup(store: DataFrame, urls: DataFrame, cdn_domain: str) -> DataFrame:
    """Metadata for each requested CDN url (NULLs when not stored)."""
    req = urls.withColumn("key", key_of_cdn_url("cdn_url", cdn_domain))
    meta = store.select("key", "content_type", "size_bytes", F.col("original_url").alias("source_url"),
                        "media_type", "upload_date")
    return req.join(meta, "key", "left")


def download(store: DataFrame, keys: DataFrame) -> DataFrame:
    """Stored objects for a key list."""
    return store.join(keys.select("key"), "key", "left_semi")


def delete_keys(store: DataFrame, keys: DataFrame) -> DataFrame:
    """The store without the deleted keys (to be written as the next
    version)."""
    return store.join(keys.select("key"), "key", "left_anti")


def retention(store: DataFrame, today: str, days: int = 30) -> DataFrame:
    """Keep objects uploaded within the last ``days`` days."""
    return store.filter(F.col("upload_date") >= F.date_sub(F.lit(today).cast("date"), days))


def decode_data_urls(refs: DataFrame, col: str = "url", min_bytes: int = 100) -> DataFrame:
    """Inline ``data:`` media. A url containing "viewBox=" together with
    "0 0" or "placeholder" is skipped; the header (text before the first
    ",") must end in ";base64" (the reference tests for ";base64," inside
    that header, which can never hold a comma, so it rejects every data
    URL; this keeps the evident intent); MIME = header between ":" and the
    first ";"; the payload is re-padded and decoded; payloads under
    ``min_bytes`` are dropped; svg/png/jpeg types are kept."""
    u = F.col(col)
    skip = u.contains("viewBox=") & (u.contains("0 0") | F.lower(u).contains("placeholder"))
    header = F.substring_index(u, ",", 1)
    ok = u.startswith("data:") & u.contains(",") & header.endswith(";base64") & ~skip
    d = refs.filter(ok)
    mime = F.element_at(F.split(F.substring_index(header, ";", 1), ":"), 2)
    payload = F.expr(f"substr({col}, instr({col}, ',') + 1)")
    pad = F.expr(f"repeat('=', (4 - length(substr({col}, instr({col}, ',') + 1)) % 4) % 4)")
    raw = F.try_to_binary(F.concat(payload, pad), F.lit("base64"))
    d = d.select("*", mime.alias("mime"), raw.alias("content"))
    d = d.filter(F.col("content").isNotNull() & (F.octet_length("content") >= min_bytes))
    m = F.lower(F.col("mime"))
    kind = (F.when(m.contains("svg"), "svg").when(m.contains("png"), "png")
            .when(m.contains("jpeg") | m.contains("jpg"), "jpg"))
    return d.withColumn("format", kind).filter(F.col("format").isNotNull())


def result_mode(envelope: DataFrame, mode: str, profile_cols, media_cols) -> DataFrame:
    """Combined / profile-only / media-only projection of a result."""
    keep = ["page_id"]
    if mode in ("combined", "profile"):
        keep += list(profile_cols)
    if mode in ("combined", "media"):
        keep += list(media_cols)
    return envelope.select(*keep)


def write_json(df: DataFrame, path: str) -> None:
    """JSON-lines results sink."""
    df.write.mode("overwrite").json(path)
