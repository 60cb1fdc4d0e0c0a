"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code (operator 4).

A file is a Parquet file whose rows are blocks of whole documents in
ascending ``doc_id`` order. A block holds

* ``ranks``: the distinct ids of the block, most frequent first (ties to the
  smaller id), as little-endian unsigned 32-bit integers. An id is written
  as its place in this list;
* ``control``: two bits a value, four values a byte, low bits first: the
  value's length in bytes less one;
* ``data``: the values, little-endian, each in its own length;
* ``doc_ids`` and ``lengths``, one entry a document, and ``block_start``, the
  number of ids before the block in its shard.

The control bytes stand apart, so a reader finds all lengths of a block by
one table lookup a control byte and then gathers the values by numpy, no
value after another. Shards are ranges of ``doc_id``; each is sorted and
written block by block, so a task holds one block, whatever its shard's
size. Blocks are committed by Spark's Parquet writer: a lost executor's
files are written again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunk_encoder, shuffle_partitions, slices, texts

#: Ids gathered before a block is closed (a longer document is a block of its own).
BLOCK_IDS = 2_000_000

BLOCK_SCHEMA = T.StructType([
    T.StructField("shard", T.IntegerType()),
    T.StructField("block_start", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("lengths", T.ArrayType(T.LongType())),
    T.StructField("ranks", T.BinaryType()),
    T.StructField("control", T.BinaryType()),
    T.StructField("data", T.BinaryType()),
])
TOKENS_SCHEMA = T.StructType([
    T.StructField("shard", T.IntegerType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("packed", T.BinaryType()),
])
DOCUMENT_SCHEMA = T.StructType([
    T.StructField("shard", T.IntegerType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("shard_start", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.BinaryType()),
])

#: Lengths of the four values of each control byte, and their sum.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1
#: Mask that leaves the first 1, 2, 3 or 4 bytes of a little-endian word.
MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ``values``."""
    v = np.ascontiguousarray(values, dtype="<u4")
    length = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    code[: len(v)] = length - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    kept = np.arange(4, dtype=np.uint8) < length[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values behind ``control`` and ``data``."""
    length = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    if not n:
        return np.zeros(0, dtype=np.uint32)
    start = np.cumsum(length) - length
    padded = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(padded, 4)[start]
    return np.ascontiguousarray(words).view("<u4").reshape(-1) & MASKS[length - 1]


def encode_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """``ranks``, ``control`` and ``data`` of the ids of a block."""
    count = np.bincount(ids) if len(ids) else np.zeros(0, dtype=np.int64)
    distinct = np.flatnonzero(count)
    ranked = distinct[np.lexsort((distinct, -count[distinct]))]
    rank = np.zeros(len(count), dtype=np.uint32)        # as large as the vocabulary
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    control, data = encode_values(rank[ids])
    return ranked.astype("<u4").tobytes(), control, data


def _shard_bounds(docs: DataFrame, n: int) -> list[int]:
    """Upper ``doc_id`` bounds of the first n - 1 of ``n`` shards, from a scan of that column alone."""
    at = [i / n for i in range(1, n)]
    found = docs.agg(F.percentile_approx("doc_id", at, max(10_000, 10 * n)).alias("b")).first()["b"] if at else []
    return sorted(set(found or []))


def tokenized(docs: DataFrame, path: str, end_id: int | None, bounds: list[int]) -> DataFrame:
    """Shard, ``doc_id``, number of ids and packed ids of every document."""
    edges = np.array(bounds, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunk_encoder(path)
        tail = b"" if end_id is None else np.array([end_id], dtype=coder.dtype).tobytes()
        width, codec = np.dtype(coder.dtype).itemsize, pa.Codec("zstd", 1)
        for b in slices(batches, 1024):
            raw = [x + tail for x in coder.encode(b["text"].to_pylist())]
            keys = [edges[0] if i is None and len(edges) else i or 0 for i in b["doc_id"].to_pylist()]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.searchsorted(edges, np.array(keys, dtype=np.int64)).astype(np.int32)), b["doc_id"],
                pa.array([len(x) // width for x in raw], pa.int64()),
                pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary())], ["shard", "doc_id", "n", "packed"])

    return texts(docs).mapInArrow(run, TOKENS_SCHEMA)


def write_token_files(docs: DataFrame, path: str, out: str, end_id: int | None = None, shards: int | None = None,
                      block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole document of ``docs`` and write its ids to token files under ``out``.

    Null texts are empty (just the end id, if one is asked for); repeated
    rows are written as often as they come, rows without ``doc_id`` in the
    first shard before all others; an empty table gives files without
    blocks. One shuffle moves compressed ids to their ``doc_id`` range.
    """
    n = shards or 4 * shuffle_partitions(docs.sparkSession)
    bounds = _shard_bounds(docs, n)
    wide = np.dtype(chunk_encoder(path).dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        shard, start, held = None, 0, 0
        ids: list[np.ndarray] = []
        keys: list[int | None] = []

        def close() -> pa.RecordBatch:
            ranks, control, data = encode_block(np.concatenate(ids))
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([start], pa.int64()), pa.array([keys], pa.list_(pa.int64())),
                pa.array([[len(x) for x in ids]], pa.list_(pa.int64())), pa.array([ranks], pa.binary()),
                pa.array([control], pa.binary()), pa.array([data], pa.binary())], BLOCK_SCHEMA.names)

        for b in slices(batches):
            for s, key, count, packed in zip(*(b[c].to_pylist() for c in ("shard", "doc_id", "n", "packed"))):
                if ids and (s != shard or held + count > block_ids):
                    yield close()
                    start, held, ids, keys = start + held, 0, [], []
                if s != shard:
                    shard, start = s, 0
                ids.append(np.frombuffer(codec.decompress(packed, count * wide.itemsize), dtype=wide))
                keys.append(key)
                held += count
        if ids:
            yield close()

    parts = shuffle_partitions(docs.sparkSession)
    (tokenized(docs, path, end_id, bounds).repartition(parts, "shard").sortWithinPartitions("shard", "doc_id", "n", "packed")
     .mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(out))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of token files: ``shard``, ``doc_id``, ``shard_start``, ``n_tokens``, ``ids`` (little-endian u32)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            row = b.to_pylist()[0]
            lengths = np.array(row["lengths"], dtype=np.int64)
            ids = np.frombuffer(row["ranks"], dtype="<u4")[decode_values(row["control"], row["data"], int(lengths.sum()))]
            ends = np.cumsum(lengths)
            for i in range(0, len(lengths), 1000):
                part = slice(i, i + 1000)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["shard"]] * len(ends[part]), pa.int32()), pa.array(row["doc_ids"][part], pa.int64()),
                    pa.array(row["block_start"] + ends[part] - lengths[part]), pa.array(lengths[part]),
                    pa.array([ids[e - n:e].astype("<u4").tobytes() for e, n in zip(ends[part], lengths[part])], pa.binary())],
                    DOCUMENT_SCHEMA.names)

    return spark.read.schema(BLOCK_SCHEMA).parquet(path).mapInArrow(run, DOCUMENT_SCHEMA)


def file_index(spark: SparkSession, path: str) -> DataFrame:
    """``shard`` and ``shard_base``, the number of ids in all shards before it: one row a shard."""
    from pyspark.sql import Window

    totals = (spark.read.schema(BLOCK_SCHEMA).parquet(path)
              .select("shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
              .groupBy("shard").agg(F.sum("n").alias("n")))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_base"))


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, decoded from the files."""
    docs = read_token_files(spark, path).select(
        "shard", "doc_id", "shard_start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return docs.join(F.broadcast(file_index(spark, path)), "shard").select(
        "doc_id", (F.col("shard_base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")
