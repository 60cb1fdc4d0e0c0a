"""Best-fit packing planned on the histogram of piece lengths (operator 9).

Documents become token ids with an end id; only documents longer than a
sequence are cut. Bins are then planned for *counts of lengths*, never for
documents: the planner sees one number for each length up to the sequence
length, fills bins by best fit, longest first, and repeats a filled bin as
often as the counts allow in one step. The plan lists, for each length, runs
of ranks and the places they take. Pieces take their places by a join on
(length, rank within the length), so the work on the driver is bounded by
the sequence length, whatever the number of documents.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunk_encoder, shuffle_partitions, slices, store, texts

PIECE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()),
])


def cut(n: int, width: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: full ones, but for a shorter first one."""
    first = n if n <= width else (n - 1) % width + 1
    return [(0, first), *((s, width) for s in range(first, n, width))]


def pieces(docs: DataFrame, path: str, end_id: int, width: int) -> DataFrame:
    """Pieces of every whole document, with ids as little-endian unsigned 32-bit integers. Null texts are empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunk_encoder(path)
        tail = np.array([end_id], dtype=coder.dtype).tobytes()
        for b in slices(batches):
            rows: list[tuple] = []
            for key, raw in zip(b["doc_id"].to_pylist(), coder.encode(b["text"].to_pylist())):
                ids = np.frombuffer(raw + tail, dtype=coder.dtype).astype("<u4")
                rows += [(key, k, s, n, ids[s:s + n].tobytes()) for k, (s, n) in enumerate(cut(len(ids), width))]
                if len(rows) > 4096:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return texts(docs).mapInArrow(run, PIECE_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], PIECE_SCHEMA.names)


def plan(counts: dict[int, int], width: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, ranks, first sequence, offset) that place ``counts`` pieces into sequences.

    Best fit, longest length first: a piece goes to the sequence with the
    least room that still takes it, and opens a new one if there is none.
    Sequences with equal room are kept as runs of neighbouring numbers, and
    all pieces of a length that meet the same room are placed in one step, so
    the steps depend on the lengths and rooms that occur, not on the counts.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    runs: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def give(room: int, first: int, many: int) -> None:
        if room not in rooms:
            rooms[room] = []
            bisect.insort(order, room)
        rooms[room].append((first, many))

    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                room = order[at]
                first, many = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(at)
            else:
                room, first, many = width, opened, left
                opened += -(-left // (width // length))
                many = opened - first
            each = room // length
            full = min(many, left // each)
            last = left - full * each if full < many else 0
            for k in range(each):
                if full:
                    runs.append((length, rank, full, first, width - room + k * length))
                    rank += full
            if full:
                give(room - each * length, first, full)
            for k in range(last):
                runs.append((length, rank, 1, first + full, width - room + k * length))
                rank += 1
            if last:
                give(room - last * length, first + full, 1)
                full += 1
            if full < many:
                give(room, first + full, many - full)
            left = counts[length] - rank
    return runs


def ranked(table: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0 within each length, to a stored table of pieces with a unique ``row``.

    Ranks are dealt in two levels, so a length that most pieces have is not
    numbered in one task: within a salt of the row number, and by the counts
    of the salts before it.
    """
    salts = 16 * shuffle_partitions(table.sparkSession)
    salted = table.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("row")
    return (salted.withColumn("k", F.row_number().over(within) - 1).join(bases, ["length", "salt"])
            .withColumn("rank", F.col("base") + F.col("k")).drop("salt", "k", "base"))


def place(table: DataFrame, width: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of ``length`` 1 to ``width``.

    The driver gets at most ``width`` counts and holds the plan of their
    runs; ranks find their run by its first rank, which is looked up in the
    sorted runs of the length and then joined by equality.
    """
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = sorted(plan(counts, width))
    if not runs:
        return table.select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    by_length: dict[int, list[tuple]] = {}
    for n, *rest in runs:
        by_length.setdefault(n, []).append(rest)
    held = {n: np.array(v, dtype=np.int64) for n, v in by_length.items()}
    names = [f.name for f in table.schema]
    schema = T.StructType([*table.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                here, runs_n = np.flatnonzero(length == n), held[int(n)]
                k = np.searchsorted(runs_n[:, 0], rank[here], side="right") - 1
                sequence[here] = runs_n[k, 2] + rank[here] - runs_n[k, 0]
                offset[here] = runs_n[k, 3]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(sequence), pa.array(offset)],
                                             [*names, "sequence_id", "offset"])

    return ranked(table).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, end_id: int = 2, width: int = 1024, keep_ids: bool = False) -> DataFrame:
    """Pack every document into sequences of at most ``width`` ids.

    Returns a row a piece: ``doc_id``, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id``, ``offset`` (and ``ids`` if asked for).
    Null and empty texts are a piece of the end id alone; repeated rows are
    packed as often as they come; an empty table gives no rows; other columns
    are ignored.
    """
    table = pieces(docs, path, end_id, width).withColumns({"ids_crc32": F.crc32("ids"), "row": F.monotonically_increasing_id()})
    table = store(table if keep_ids else table.drop("ids"), "pieces")
    return place(table, width).drop("row", "rank")
