"""Operator 11: spelling variants grouped by dense tiles of padded code points.

The words of all documents are counted once (each task sums its own first);
everything after that is as large as the vocabulary. Two words are one edit
apart if their common prefix and common suffix together reach the longer
length L less one. So, if the L places are cut into a few parts, the edit lies
within one of them and the words agree on all before it and all behind it.
Each word is entered under what is left of it for each part, for L its own
length and one more, and only words of one entry can be near. Entries are laid
out in tiles: two blocks of words as matrices of code points, padded at the
right for prefixes and at the left for suffixes, compared column by column,
all pairs of a tile at once. A tile gives for each word how many it is near to
and the best of them, never the pairs.

An entry shared by many words is cut into blocks by hash, and each pair of
blocks is a group of its own, so no group exceeds two blocks by more than
chance; a larger one is compared tile by tile all the same.

Defined cases: null texts have no words, a null ``doc_id`` counts as the empty
text in the hash of a run, equal rows count as often as they stand, an empty
table gives no rows, further columns are dropped. The hash drops a letter from
about one run of a document in 97, wherever the run stands in it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, slices, store

#: Latin-1 bytes: A-Z in lower case, a-z and all from 192 on as they are, all others (and "?" for what is beyond) blank.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))
#: Counted words that a task holds before it sends them on.
HELD_WORDS = 200_000
#: Words of a block, of a tile at most, and code points of a tile's matrix at most.
BLOCK = 256
TILE = 512
TILE_POINTS = 1 << 21
#: Entries that are compared together where groups are smaller.
TOGETHER = 128
#: Role of a word in the pair of a block with itself.
BOTH = 2


def count_words(docs: DataFrame, drop_one_in: int = 97) -> DataFrame:
    """``word`` and ``n``: all runs of letters, some of them with one letter dropped by the hash of document and run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def sent() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in total]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                seed = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                counts = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())
                total.update(counts)
                for word, n in counts.items():
                    h = crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
                    if not h % drop_one_in:
                        at = h % len(word)
                        total[word] -= n
                        total[word[:at] + word[at + 1:]] += n
                if len(total) >= HELD_WORDS:
                    yield sent()
                    total.clear()
        if total:
            yield sent()

    return (docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"))


def _matrix(words: list[str], width: int, right: bool) -> np.ndarray:
    """Code points of words as the columns of a matrix, from its first row on or up to its last one; 0 elsewhere."""
    padded = "".join([w.rjust(width, "\0") if right else w.ljust(width, "\0") for w in words])
    try:
        points = np.frombuffer(padded.encode("latin-1"), dtype=np.uint8)
    except UnicodeEncodeError:
        points = np.frombuffer(padded.encode("utf-32-le"), dtype="<u4")
    return np.ascontiguousarray(points.reshape(len(words), width).T)


def _common(a: np.ndarray, b: np.ndarray, rows) -> np.ndarray:
    """Rows that each pair of columns agrees on, from the first on without a gap; ends when no pair agrees any more."""
    alive = np.ones((a.shape[1], b.shape[1]), dtype=bool)
    reached = np.zeros(alive.shape, dtype=np.int16 if a.shape[0] < 1 << 15 else np.int32)
    for j in rows:
        alive &= (a[j][:, None] == b[j][None, :]) & (a[j] != 0)[:, None]
        if not alive.any():
            break
        reached += alive
    return reached


def common_ends(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the common prefix and the common suffix of each pair of words of two blocks."""
    width = max(map(len, [*a, *b]))
    return (_common(_matrix(a, width, False), _matrix(b, width, False), range(width)),
            _common(_matrix(a, width, True), _matrix(b, width, True), range(width - 1, -1, -1)))


class _Entries:
    """Entries of some whole groups, as columns."""

    def __init__(self, rows: pa.RecordBatch, groups: np.ndarray):
        self.words = rows.column("word")
        self.word = self.words.to_pylist()
        self.part, self.long, self.role, self.n = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("part", "long", "role", "n"))
        self.group = groups
        self.size = np.array([len(w) for w in self.word])
        self.rank = np.empty(len(self.word), dtype=np.int64)      # commonest first, ties by code points
        self.order = np.array(sorted(range(len(self.word)), key=lambda i: (-self.n[i], self.word[i])))
        self.rank[self.order] = np.arange(len(self.order))

    def near(self, a: slice, b: slice, parts: int) -> np.ndarray:
        """Pairs of two tiles that are one edit apart: in the same group, and each pair of words in one group only."""
        prefix, suffix = common_ends(self.word[a], self.word[b])
        longer = np.maximum(self.size[a][:, None], self.size[b][None, :])
        apart = np.abs(self.size[a][:, None] - self.size[b][None, :])
        long = self.long[a][:, None]
        near = (self.group[a][:, None] == self.group[b][None, :]) & (longer == long)    # shorter pairs meet under their own length
        near &= (apart <= 1) & (prefix + suffix >= longer - 1) & ~((apart == 0) & (prefix == longer))
        near &= (self.role[a][:, None] != self.role[b][None, :]) | (self.role[a] == BOTH)[:, None]
        for j in range(parts - 1):      # a pair that agrees around several parts counts under the first
            around = (prefix >= long * j // parts) & (suffix >= long - long * (j + 1) // parts)
            near &= ~(around & (self.part[a] > j)[:, None])
        return near

    def best(self, a: slice, b: slice, near: np.ndarray) -> pa.RecordBatch:
        """For the words of a tile that are near to some of another one: how many, and the commonest."""
        counts = near.sum(axis=1)
        hit = np.flatnonzero(counts)
        top = self.order[np.where(near[hit], self.rank[b][None, :], len(self.rank)).min(axis=1)] if len(hit) else hit
        return pa.RecordBatch.from_arrays(
            [self.words.take(pa.array(hit + a.start)), pa.array(counts[hit], pa.int64()), pa.array(self.n[top], pa.int64()),
             self.words.take(pa.array(top))], names=["word", "n_near", "form_n", "form"])

    def compared(self, parts: int) -> Iterator[pa.RecordBatch]:
        side = max(1, min(TILE, TILE_POINTS // int(self.size.max())))
        tiles = [slice(i, min(i + side, len(self.word))) for i in range(0, len(self.word), side)]
        for i, a in enumerate(tiles):
            for b in tiles[i:]:
                if self.group[b.start] > self.group[a.stop - 1]:
                    break
                near = self.near(a, b, parts)
                yield self.best(a, b, near)
                if b != a:
                    yield self.best(b, a, near.T)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[_Entries]:
    """Rows sorted by group, in lots of whole groups."""
    held = None
    for batch in chain(batches, (None,)):
        if batch is not None:
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if held is None or not held.num_rows:
            continue
        group = held.column("group")
        new = pc.not_equal(group[1:], group[:-1]).to_numpy(zero_copy_only=False)
        code = np.concatenate([[0], np.cumsum(new)])
        long = held.column("long").to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(new) + 1
        at, most, last = 0, 0, 0
        for end in [*ends.tolist(), *([held.num_rows] if batch is None else [])]:
            size = int(long[end - 1])
            if last > at and max(most, size) * (end - at) > TILE_POINTS:
                yield _Entries(held.slice(at, last - at), code[at:last])
                at, most = last, 0
            most, last = max(most, size), end
            if end - at >= TOGETHER:
                yield _Entries(held.slice(at, end - at), code[at:end])
                at, most = end, 0
        if batch is None and last > at:
            yield _Entries(held.slice(at, last - at), code[at:last])
        held = held.slice(at)


def near_words(words: DataFrame, block: int = BLOCK, parts: int = 3) -> DataFrame:
    """``word, n_near, form, form_n``: how many words of ``words(word, n)`` are one edit away, and the commonest of them.

    Ties go to the smallest word in the order of code points. Words without a near word have no row.
    """
    length = F.length("word")

    def entry(part: int, more: int) -> Column:
        """What is left of a word around one part of the places of a word of ``more`` letters more than it."""
        long = length + more
        first = F.floor(long * part / parts).cast("int")
        behind = (long - F.floor(long * (part + 1) / parts)).cast("int")
        return F.struct(F.lit(part).alias("part"), long.alias("long"), F.substring("word", F.lit(1), first).alias("head"),
                        F.when(behind > 0, F.substring("word", length - behind + 1, behind)).otherwise("").alias("tail"))

    entries = words.select("word", "n", F.inline(F.array(*[entry(p, more) for p in range(parts) for more in (0, 1)])))
    key = ["part", "long", "head", "tail"]
    sizes = entries.groupBy(*key).agg(F.count("*").alias("members")).filter(F.col("members") > block)
    entries = entries.join(sizes, key, "left").withColumn(
        "blocks", F.coalesce(F.ceil(F.col("members") / block), F.lit(1)).cast("int")).withColumn(
        "own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    # every pair of blocks (x <= y) of an entry is a group, in which a word has the role of its block
    placed = entries.select("word", "n", *key, "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    role = F.when(F.col("own") == F.col("other"), BOTH).when(F.col("own") < F.col("other"), 0).otherwise(1)
    group = F.concat_ws(":", "part", "long", F.least("own", "other"), F.greatest("own", "other"), "head", "tail")
    dealt = placed.select(group.alias("group"), "part", "long", role.alias("role"), "n", "word")
    dealt = dealt.repartition(shuffle_partitions(words.sparkSession), "group").sortWithinPartitions("group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _whole_groups(batches):
            yield from lot.compared(parts)

    near = dealt.mapInArrow(run, "word string, n_near long, form_n long, form string")
    order = F.struct((-F.col("form_n")).alias("less"), F.col("form"))
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(order).alias("best")).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of each word's chain of forms, for the rows of ``forms(word, form)`` that have a form.

    Every round lets a pointer jump as far as its target has come, so chains
    of k forms take about log2(k) rounds; forms are at least twice as
    frequent as their words, so k is below the binary logarithm of the
    largest count.
    """
    chain = store(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "chains")
    while True:
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = store(chain.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chains")
        chain = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            return chain


def variants(docs: DataFrame, least_length: int = 5, least_n: int = 3, times: int = 2, drop_one_in: int = 97) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the documents."""
    words = store(count_words(docs, drop_one_in).filter((F.length("word") >= least_length) & (F.col("n") >= least_n)), "words")
    near = words.join(near_words(words), "word", "left")
    is_form = F.col("form_n") >= times * F.col("n")
    formed = store(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                               F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")), "forms")
    return formed.join(roots(formed), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
