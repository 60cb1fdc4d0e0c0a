"""Operator 13: how the sources of a language differ in their words, by chunk factorization.

A chunk is a run of anything but ASCII blanks; no term crosses its ends. Each
task counts the chunks of its documents: a row for each language and chunk has
the documents and, by source, the occurrences. Each distinct chunk is then
tokenized once, and its terms are joined back to the counts. Occurrences of a term are sums over
its chunks; the documents of a term are not, since one document may hold
several of its chunks, but they lie between those of its commonest chunk and
the sum of all. Only terms that these two bounds leave open are counted
exactly, from the documents of their chunks: each of those chunks is rarer
than the limit, so its documents were carried along as a short list, and no
common chunk is ever spread over its documents.

Sums over all pairs of sources run in slices of 50,000 to a million counts, so
that a slice has more counts than pairs: each slice is a matrix of sources by
terms, and its pair sums are added up. Sources that lack a term have the probability that the formula gives to a count of 0.

Defined cases: null texts, languages and sources count as empty texts, a row
is a document (equal rows are several), ``doc_id`` and further columns play no
part, an empty table gives no rows. All arithmetic is on integers; those that
can pass 64 bits are decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, slices, store

#: Words, and distinct chunks, that a task counts before it sends the counts on.
HELD_WORDS, HELD_CHUNKS = 6_000_000, 800_000
#: Counts of a slice of pair sums, the most that it grows to where there are many sources, and sources of one block of its matrix.
SLICE_COUNTS, SLICE_MOST = 50_000, 1_000_000
SOURCE_BLOCK = 32
#: Bits of a cell below the number of its group or task.
CELL_BITS = 32
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class _Counts:
    """Chunks of some documents as numbers, until they are counted."""

    def __init__(self):
        self.chunks: dict[str, int] = {}
        self.groups: dict[tuple[str, int], int] = {}
        self.codes: list[np.ndarray] = []
        self.doc_words: list[np.ndarray] = []
        self.doc_group: list[int] = []
        self.n_words = 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.doc_group += [self.groups.setdefault(g, len(self.groups))
                           for g in zip(batch.column("lang").to_pylist(), batch.column("grp").to_pylist())]
        found = pc.ascii_split_whitespace(batch.column("text"))
        self.doc_words.append(pc.list_value_length(found).to_numpy(zero_copy_only=False))
        distinct = found.flatten().dictionary_encode()
        known = np.array([self.chunks.setdefault(c, len(self.chunks)) for c in distinct.dictionary.to_pylist()], dtype=np.int32)
        self.codes.append(known[distinct.indices.to_numpy()])
        self.n_words += len(distinct)

    def summed(self, task: int, first_row: int, limit: int) -> pa.RecordBatch:
        """A row for each language and chunk."""
        langs = {lang: i for i, lang in enumerate(dict.fromkeys(lang for lang, _ in self.groups))}
        lang_of = np.array([langs[lang] for lang, _ in self.groups])
        doc_group = np.array(self.doc_group)
        by_group = np.argsort(doc_group, kind="stable")     # documents in the order of their sources
        place = np.empty_like(by_group)
        place[by_group] = np.arange(len(by_group))
        doc = np.repeat(np.arange(len(doc_group)), np.concatenate(self.doc_words))
        key = (lang_of[doc_group[doc]] * len(self.chunks) + np.concatenate(self.codes)) * len(doc_group) + place[doc]
        empty = self.chunks.get("")
        key, times = np.unique(key, return_counts=True)
        pair, doc = key // len(doc_group), by_group[key % len(doc_group)]
        del key
        if empty is not None:       # what stands before a leading blank
            words = pair % len(self.chunks) != empty
            pair, doc, times = pair[words], doc[words], times[words]
        group = doc_group[doc]
        new = np.concatenate([[True], pair[1:] != pair[:-1]])[:len(pair)]
        starts = np.flatnonzero(new)
        n_docs = np.diff(starts, append=len(pair))
        source_starts = np.flatnonzero(new | np.concatenate([[True], group[1:] != group[:-1]])[:len(pair)])
        n = np.add.reduceat(times, source_starts) if len(pair) else times
        rare = n_docs < limit
        # a cell for each source, then one for each document of a rare chunk
        offsets = np.searchsorted(source_starts, np.append(starts, len(pair)))
        row_offsets = np.concatenate([[0], np.cumsum(np.where(rare, n_docs, 0))])
        cell_offsets = offsets + row_offsets
        cells = np.empty(cell_offsets[-1], dtype=np.int64)
        number = np.array([grp for _, grp in self.groups], dtype=np.int64)
        cells[np.repeat(row_offsets[:-1], np.diff(offsets)) + np.arange(offsets[-1])] = number[group[source_starts]] << CELL_BITS | n
        cells[np.repeat(offsets[1:], np.diff(row_offsets)) + np.arange(row_offsets[-1])] = -1 - (
            np.int64(task) << CELL_BITS | doc[np.repeat(rare, n_docs)] + first_row)
        lang, chunk = pair[starts] // len(self.chunks), pair[starts] % len(self.chunks)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(langs), pa.string()).take(pa.array(lang)), pa.array(list(self.chunks), pa.string()).take(pa.array(chunk)),
             pa.array(n_docs, pa.int64()), pa.ListArray.from_arrays(pa.array(cell_offsets, pa.int32()), pa.array(cells))],
            names=["lang", "chunk", "n_docs", "cells"])


def numbered_groups(docs: DataFrame) -> DataFrame:
    """``lang, source, grp``: a number from 0 for each group of ``docs``, stored."""
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    found = store(groups.withColumn("at", F.monotonically_increasing_id()), "groups")
    # the upper bits are the partition: a row each comes to the driver, the groups before it
    part = F.shiftright("at", 33)
    sizes = sorted(found.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = [F.lit(x) for x, n in zip([0, *np.cumsum([r["n"] for r in sizes]).tolist()], sizes) for x in (n["part"], x)]
    first = F.create_map(*before)[part] if before else F.lit(0)
    return store(found.select("lang", "source", (first + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("grp")), "numbered-groups")


def chunk_counts(docs: DataFrame, groups: DataFrame, limit: int) -> DataFrame:
    """``lang, chunk, n_docs, cells``: sums of each task.

    ``cells`` are whole numbers, each one word in a shuffle. From 0 on, one is a group's number (``grp`` of
    ``groups``) above ``CELL_BITS`` bits with the chunk's occurrences in it; a negative one names a document of a
    chunk that is in fewer than ``limit`` of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row, held = TaskContext.get().partitionId(), 0, _Counts()
        for batch in slices(batches, 1024):
            held.add(batch)
            if held.n_words >= HELD_WORDS or len(held.chunks) >= HELD_CHUNKS:
                yield held.summed(task, row, limit)
                row, held = row + len(held.doc_group), _Counts()
        if held.n_words:
            yield held.summed(task, row, limit)

    read = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return (read.join(groups, ["lang", "source"]).select("lang", "grp", "text")
            .mapInArrow(run, "lang string, chunk string, n_docs long, cells array<long>"))


def chunk_terms(parts: DataFrame) -> DataFrame:
    """``lang, chunk, n_docs, term, times``: each distinct chunk tokenized once, its terms joined back to its counts.

    One shuffle by chunk serves both: the sums by language of a chunk (as many as there are languages) meet in its
    row, which is tokenized and spread over its languages and terms.
    """
    dealt = parts.select("lang", "chunk", "n_docs").repartition("chunk")
    counts = (dealt.groupBy("chunk", "lang").agg(F.sum("n_docs").alias("n_docs"))
              .groupBy("chunk").agg(F.collect_list(F.struct("lang", "n_docs")).alias("counts")))
    terms = F.transform(F.regexp_extract_all("chunk", F.lit(TERM), F.lit(0)), lambda t: F.translate(t, UPPER, LOWER))
    found = counts.select("chunk", "counts", terms.alias("terms")).select(
        "chunk", "counts", "terms", F.explode(F.array_distinct("terms")).alias("term"))
    times = F.when(F.size("terms") == 1, 1).otherwise(F.size(F.filter("terms", lambda t: t == F.col("term")))).cast("long")
    return found.select("chunk", "term", times.alias("times"), F.inline("counts")).select("lang", "chunk", "n_docs", "term", "times")


def term_bounds(terms: DataFrame, limit: int) -> DataFrame:
    """``lang, term, least, most``: bounds of the documents of each term that may be in ``limit`` of them."""
    return terms.groupBy("lang", "term").agg(F.max("n_docs").alias("least"), F.sum("n_docs").alias("most")).filter(F.col("most") >= limit)


def term_cells(parts: DataFrame, terms: DataFrame, bounds: DataFrame, limit: int) -> DataFrame:
    """One pass over the counted chunks: ``lang, term, cell, n``, where ``cell`` is a group's number and ``n`` its
    occurrences or, below 0, a document of a term that the bounds leave open."""
    is_open = F.col("least") < limit
    wanted = terms.join(bounds.select("lang", "term", is_open.alias("open")), ["lang", "term"]).select("lang", "chunk", "term", "times", "open")
    counted, occurrences = F.col("cell") >= 0, F.col("cell").bitwiseAND(F.lit((1 << CELL_BITS) - 1))
    return (parts.select("lang", "chunk", "cells").join(wanted, ["lang", "chunk"])
            .select("lang", "term", "times", "open", F.explode("cells").alias("cell")).filter(counted | F.col("open"))
            .select("lang", "term", F.when(counted, F.shiftright("cell", CELL_BITS)).otherwise(F.col("cell")).alias("cell"),
                    F.when(counted, occurrences * F.col("times")).otherwise(0).alias("n"))
            .groupBy("lang", "term", "cell").agg(F.sum("n").alias("n")))


def kept_terms(bounds: DataFrame, cells: DataFrame, limit: int) -> DataFrame:
    """``lang, term`` of the terms in at least ``limit`` documents of a language."""
    exact = cells.filter("cell < 0").groupBy("lang", "term").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= limit)
    return bounds.filter(F.col("least") >= limit).select("lang", "term").unionByName(exact.select("lang", "term"))


def _share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 size)), exactly."""
    wide = "decimal(38,0)"
    above = (count.cast("decimal(25,0)") + 5) * F.lit(10 ** 9).cast("decimal(12,0)")
    below = (total.cast("decimal(25,0)") + size.cast("decimal(20,0)") * 5).cast(wide)
    return F.when(below > 0, F.lit(1) + F.call_function("div", above.cast(wide), below)).otherwise(F.lit(1)).cast("long")


def pair_sums(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums of |p - q| over the terms of a slice for each pair of sources; rows without a term give a source's ``none``."""
    groups = frame[frame["term"].isna()].sort_values("source")
    counts = frame[frame["term"].notna()]
    names = groups["source"].to_numpy()
    place = pd.Index(names).get_indexer(counts["source"])
    column, terms = pd.factorize(counts["term"])
    none, n = groups["none"].to_numpy(), len(names)
    order = np.argsort(place, kind="stable")
    place, column, p = place[order], column[order], counts["p"].to_numpy()[order]
    cuts = np.searchsorted(place, np.arange(n + 1))

    def block(at: int) -> np.ndarray:
        """Probabilities of the terms in some sources, a row each."""
        out = np.repeat(none[at:at + SOURCE_BLOCK, None], len(terms), axis=1)
        span = slice(cuts[at], cuts[min(at + SOURCE_BLOCK, n)])
        out[place[span] - at, column[span]] = p[span]
        return out

    one, other, value = [], [], []
    for i in range(0, n, SOURCE_BLOCK):
        a = block(i)
        for j in range(i, n, SOURCE_BLOCK):
            b = block(j) if j > i else a
            for k in range(len(a)):
                sums = np.abs(b - a[k]).sum(axis=1)
                from_k = k + 1 if i == j else 0
                one += [names[i + k]] * (len(b) - from_k)
                other += names[j + from_k:j + len(b)].tolist()
                value += sums[from_k:].tolist()
    found = {"lang": [frame["lang"].iloc[0]] * 2 * len(one), "source": [*one, *other], "item": [*other, *one]}
    return pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in found.items()}).assign(
        value=np.array([*value, *value], dtype=np.int64))


def audit(docs: DataFrame, limit: int = 30, ranks: int = 50, slice_counts: int = SLICE_COUNTS) -> DataFrame:
    """``lang, source, part, item, value, rank``: other sources by distance, and the terms that a source uses most beyond its language."""
    path = scratch_path(docs.sparkSession, "chunk-counts")      # the largest table: packed tighter than by default
    numbered = numbered_groups(docs)
    chunk_counts(docs, numbered, limit).write.option("compression", "zstd").parquet(path)
    parts = docs.sparkSession.read.parquet(path)
    terms = store(chunk_terms(parts), "chunk-terms")
    bounds = store(term_bounds(terms, limit), "term-bounds")
    cells = store(term_cells(parts, terms, bounds, limit), "term-cells")
    kept = store(kept_terms(bounds, cells, limit), "kept-terms")
    groups = numbered.select("lang", "source")
    named = cells.filter("cell >= 0").join(kept, ["lang", "term"]).join(numbered.select(F.col("grp").alias("cell"), "source"), "cell")
    counts = store(named.select("lang", "source", "term", "n"), "term-counts")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("size"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    filled = counts.groupBy("lang").agg(F.count("*").alias("filled"))
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    per_slice = F.greatest(F.lit(slice_counts), F.least(F.col("sources") * F.col("sources"), F.lit(SLICE_MOST)))
    zero = F.lit(0)
    groups = store(groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").join(filled, "lang", "left").join(sources, "lang").select(
        "lang", "source", F.coalesce("size", zero).alias("size"), F.coalesce("total", zero).alias("total"),
        F.ceil(F.coalesce("filled", zero) / per_slice).cast("int").alias("slices")).withColumn(
        "none", _share(zero, F.col("total"), F.col("size"))), "source-groups")

    own = counts.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("size")))
    in_slice = own.select("lang", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"), "source", "term", "p", "none")
    lacking = groups.filter("slices > 0").select(
        "lang", F.explode(F.sequence(zero, F.col("slices") - 1)).alias("slice"), "source",
        F.lit(None).cast("string").alias("term"), F.col("none").alias("p"), "none")
    sums = (in_slice.unionByName(lacking).groupBy("lang", "slice")
            .applyInPandas(pair_sums, "lang string, source string, item string, value long")
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = (groups.select("lang", "source").join(others, "lang").filter("source <> item")
             .join(sums, ["lang", "source", "item"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", zero).cast("long").alias("value")))

    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    lang_total = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    above = (own.join(of_lang, ["lang", "term"]).join(lang_total, "lang")
             .withColumn("value", F.col("p") - _share(F.col("lang_n"), F.col("lang_total"), F.col("size")))
             .filter("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value"))
    best_first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (above.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= ranks)
            .unionByName(pairs.withColumn("rank", F.row_number().over(best_first))))
