"""Exact top-k search by tiled matrix products (operator 2).

Vectors are gathered into shards and query vectors into blocks; a tile is
the matrix product of one block and one shard. Each tile keeps only its k
best columns a query (partial selection), and the short lists meet in a tree
of merges, never in one task or on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import store

HIT_SCHEMA = T.StructType([
    T.StructField("query_row", T.LongType()),
    T.StructField("query_id", T.LongType()),
    T.StructField("shard", T.IntegerType()),
    T.StructField("row", T.LongType()),
    T.StructField("vec_id", T.LongType()),
    T.StructField("score", T.LongType()),
])
TILE_SCHEMA = T.StructType([
    T.StructField("tile", T.IntegerType()),
    T.StructField("rows", T.BinaryType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("matrix", T.BinaryType()),
])
_LONG = (-(1 << 63), (1 << 63) - 1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of two matrices of whole numbers held as float64.

    Below 2**53 a float product is exact; beyond, Python integers are used
    and scores outside the 64-bit range are held at its ends.
    """
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    wide = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    return np.array([[min(max(x, _LONG[0]), _LONG[1]) for x in r] for r in wide], dtype=np.int64).reshape(len(a), len(b))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` best scores of a query, ties to the smaller id; all columns if fewer."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        cols = np.flatnonzero(scores >= least)
    else:
        cols = np.arange(len(scores))
    return cols[np.lexsort((ids[cols], -scores[cols]))[:k]]


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``vec_id``, whole-number vector and its dimension; vectors null, or with null or non-finite parts, are left out."""
    x = F.col(vector_col)
    good = F.forall(x, lambda v: F.coalesce((F.abs(v.cast("double")) < F.lit(float("inf"))) & ~F.isnan(v), F.lit(False)))
    return vectors.filter(x.isNotNull() & good).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(x, lambda v: _floor(v.cast("double") * F.lit(scale))).alias("vector"),
        F.size(x).alias("dim"))


def _floor(x: Column) -> Column:
    """Largest whole number not above ``x``, as a double (Spark's floor would overflow beyond 64 bits)."""
    whole = F.rint(x)
    return F.when(whole > x, whole - 1.0).otherwise(whole)


def tiles(rows: DataFrame, size: int) -> DataFrame:
    """Rows dealt into numbered tiles of about ``size`` vectors of one dimension, each packed into one row."""
    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "tile": [key[0]], "rows": [group["row"].to_numpy(np.int64).tobytes()],
            "ids": [group["vec_id"].to_numpy(np.int64).tobytes()],
            "matrix": [np.stack(group["vector"].to_list()).astype("<f8").tobytes() if key[1] else b""]})

    return rows.groupBy("tile", "dim").applyInPandas(pack, TILE_SCHEMA)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id",
          vector_col: str = "embedding", shard_rows: int = 4096, block_rows: int = 1024, fan_in: int = 16,
          lane_shards: int = 16) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of each query row's ``k`` best other rows.

    Each shard of vectors is shuffled once, to its lane of at most
    about ``lane_shards`` shards (fewer where cores would idle); the blocks of queries, the smaller side, go to
    every lane. Nothing is broadcast: a lane's shards are what a task holds
    while blocks of queries pass by.

    ``is_query`` is a condition on the id column. Components are taken as
    floor(scale * x); the score is their inner product; ties go to the
    smaller id. Null vectors and vectors with null or non-finite parts take
    no part; vectors of another length than the query's are no candidates;
    fewer candidates than ``k`` are all returned; repeated ids are rows of
    their own. A null id makes a candidate that ranks last among equals, and
    no query.
    """
    spark = vectors.sparkSession
    rows = store(usable(vectors, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    asked = rows.filter(is_query & F.col("vec_id").isNotNull())
    blocks = max(1, -(-asked.count() // block_rows))
    deal = lambda df, many: df.withColumn("tile", F.pmod(F.xxhash64("row"), F.lit(many)).cast("int"))
    packed = tiles(deal(rows.withColumn("vec_id", F.coalesce("vec_id", F.lit(_LONG[1]))), shards), shard_rows)
    queries = store(tiles(deal(asked, blocks), block_rows).select(
        F.col("tile").alias("block"), F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"),
        F.col("matrix").alias("q_matrix")), "query-blocks")
    # every shard meets every block of queries: the stated query set against all rows, as whole tiles
    lanes = max(-(-shards // lane_shards), min(shards, spark.sparkContext.defaultParallelism))
    # merged, never broadcast: the blocks stream past the lane's shards, whose number is bounded
    pairs = (queries.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).repartition(lanes, "lane")
             .hint("merge").join(packed.withColumn("lane", F.col("tile") % lanes).repartition(lanes, "lane"), "lane"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t = {c: batch[c][i].as_py() for c in batch.schema.names}
                q_rows, q_ids = np.frombuffer(t["q_rows"], np.int64), np.frombuffer(t["q_ids"], np.int64)
                c_rows, c_ids = np.frombuffer(t["rows"], np.int64), np.frombuffer(t["ids"], np.int64)
                a = np.frombuffer(t["q_matrix"], "<f8").reshape(len(q_rows), -1)
                b = np.frombuffer(t["matrix"], "<f8").reshape(len(c_rows), -1)
                if a.shape[1] != b.shape[1]:
                    continue
                scores = products(a, b)
                out: list[tuple] = []
                for q in range(len(q_rows)):
                    other = np.flatnonzero(c_rows != q_rows[q])
                    hits = other[best(scores[q, other], c_ids[other], k)]
                    out += [(q_rows[q], q_ids[q], t["tile"], c_rows[c], c_ids[c], scores[q, c]) for c in hits]
                cols = list(zip(*out)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(x) for x in col], pa.int32() if j == 2 else pa.int64()) for j, col in enumerate(cols)],
                    HIT_SCHEMA.names)

    hits = pairs.mapInArrow(multiply, HIT_SCHEMA)
    order = [F.desc("score"), F.asc("vec_id"), F.asc("row")]
    while shards > fan_in:  # a level of the merge tree: lists of fan_in shards become one list
        shards = -(-shards // fan_in)
        hits = hits.withColumn("shard", F.floor(F.col("shard") / fan_in).cast("int"))
        hits = (hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_row", "shard").orderBy(*order)))
                .filter(F.col("rank") <= k).drop("rank"))
    last = Window.partitionBy("query_row").orderBy(*order)
    return (hits.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.when(F.col("vec_id") != _LONG[1], F.col("vec_id")).alias("vec_id"), "score"))
