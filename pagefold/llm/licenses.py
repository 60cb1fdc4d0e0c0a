"""License scans by diagonal voting (operator 10).

Every rolling word k-gram of every document is joined in Spark to the
positions of that k-gram in the license templates. A match at word i of the
document and word j of the template votes for the diagonal i - j: an
unbroken copy puts all its votes on one diagonal, an inserted or lost word
moves the rest to a neighbouring one. Votes are aggregated by (document,
template, diagonal), neighbouring diagonals are merged into a span, and a
span counts when the template words that its votes cover are a large enough
share of the template and of the span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_key, texts
from .words import LETTER_WORDS, batch_word_hashes, gram_hashes

#: Phrases and labels of the base rule.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices of well-known licenses by label. A caller may pass others.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)

BASE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("key", T.StringType()),
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.ArrayType(T.StringType())),
])
GRAM_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("key", T.StringType()),
    T.StructField("grams", T.ArrayType(T.LongType())),
])


def _words(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(LETTER_WORDS)


def phrase_places(docs: DataFrame, phrases: dict[str, str] | None = None) -> DataFrame:
    """Words of each document, and the places where the words of a phrase stand one after another."""
    wanted = [(p.encode().split(), label) for p, label in (phrases or PHRASES).items()]

    def places(words: list[bytes], text: bytes, phrase: list[bytes]) -> list[int]:
        if b" ".join(phrase[:1]) not in text or phrase[-1] not in text:
            return []
        out, at = [], -1
        try:
            while True:
                at = words.index(phrase[0], at + 1)
                if words[at:at + len(phrase)] == phrase:
                    out.append(at)
        except ValueError:
            return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for key, content, text in zip(*(b[c].to_pylist() for c in ("doc_id", "key", "text"))):
                blanked = _words(text)
                words = blanked.split()
                found = [(i, label) for p, label in wanted for i in places(words, blanked, p)]
                at = [i for i, _ in found]
                rows.append((key, content, len(words), len(at), min(at, default=None), max(at, default=None),
                             sorted({label for _, label in found})))
            yield pa.RecordBatch.from_pylist([dict(zip(BASE_SCHEMA.names, r)) for r in rows], schema=_ARROW_BASE)

    return texts(docs.withColumn("key", text_key()), "key").mapInArrow(run, BASE_SCHEMA)


_ARROW_BASE = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("n_words", pa.int64()), ("n_base", pa.int64()),
                         ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string()))])


def rolling_grams(docs: DataFrame, k: int) -> DataFrame:
    """A row for every rolling word ``k``-gram of every document: ``doc_id``, ``key``, ``pos``, ``gram`` (64-bit hash)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            grams = [gram_hashes(h, k).view(np.int64) for h in batch_word_hashes([_words(t) for t in b["text"].to_pylist()])]
            ends = np.cumsum([0, *(len(g) for g in grams)], dtype=np.int32)
            flat = pa.array(np.concatenate(grams) if grams else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["key"], pa.ListArray.from_arrays(pa.array(ends), flat)], GRAM_SCHEMA.names)

    return (texts(docs.withColumn("key", text_key()), "key").mapInArrow(run, GRAM_SCHEMA)
            .select("doc_id", "key", F.posexplode("grams").alias("pos", "gram")))


def template_grams(spark: SparkSession, templates: tuple[tuple[str, str], ...], k: int) -> DataFrame:
    """``template``, ``label``, ``n`` (words), ``tpos`` and ``gram`` of every k-gram of the templates."""
    rows = []
    for i, (label, text) in enumerate(templates):
        hashes = batch_word_hashes([_words(text)])[0]
        rows += [(i, label, len(hashes), j, int(g)) for j, g in enumerate(gram_hashes(hashes, k).view(np.int64))]
    return spark.createDataFrame(rows, "template int, label string, n int, tpos int, gram long")


def license_spans(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, k: int = 3, slack: int = 3,
                  least_cover: float = 0.8, least_density: float = 0.5) -> DataFrame:
    """Verified spans: ``doc_id``, ``key``, ``template``, ``label``, ``first_word``, ``end_word``, ``cover``.

    ``cover`` is the share of the template's words that the votes of the
    merged diagonals cover. Of spans that overlap, the best covered stay
    (notices of two versions of a license differ in a word). The template grams are the only broadcast side:
    their number is that of the words of the ``templates`` parameter.
    """
    spark = docs.sparkSession
    votes = (rolling_grams(docs, k).join(F.broadcast(template_grams(spark, templates, k)), "gram")
             .groupBy("doc_id", "key", "template", "label", "n", (F.col("pos") - F.col("tpos")).alias("diagonal"))
             .agg(F.collect_set("tpos").alias("tpos"), F.min("pos").alias("lo"), F.max("pos").alias("hi")))
    spot = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    opens = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(spot) > slack, F.lit(True))
    merged = (votes.withColumn("run", F.sum(F.when(opens, 1).otherwise(0)).over(spot))
              .groupBy("doc_id", "key", "template", "label", "n", "run")
              .agg(F.array_distinct(F.flatten(F.collect_list("tpos"))).alias("tpos"),
                   F.min("lo").alias("first_word"), (F.max("hi") + k).alias("end_word")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("tpos", lambda t: F.sequence(t, t + k - 1)))))
    spans = (merged.withColumn("cover", covered / F.col("n"))
             .filter((F.col("cover") >= least_cover)
                     & (covered >= least_density * (F.col("end_word") - F.col("first_word")))))
    along = Window.partitionBy("doc_id", "key").orderBy("first_word", "end_word", "template")
    apart = F.col("first_word") >= F.max("end_word").over(along.rowsBetween(Window.unboundedPreceding, -1))
    place = Window.partitionBy("doc_id", "key", "place")
    return (spans.withColumn("apart", F.coalesce(apart, F.lit(True)))
            .withColumn("place", F.sum(F.col("apart").cast("int")).over(along))
            .withColumn("most", F.max("cover").over(place)).filter(F.col("cover") == F.col("most"))
            .select("doc_id", "key", "template", "label", "first_word", "end_word", "cover"))


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: tuple[tuple[str, str], ...] = TEMPLATES,
         k: int = 3, base_score: float = 0.5) -> DataFrame:
    """Base phrases and license labels of every document.

    Null texts are empty: no words, no labels, score 0. Equal rows share
    their spans and keep a result row each; other columns are ignored; an
    empty table gives no rows. ``score`` is the best cover of a verified
    span, at least ``base_score`` where a base phrase stands.
    """
    found = (license_spans(docs, templates, k).groupBy("doc_id", "key")
             .agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
             .withColumnsRenamed({"doc_id": "m_doc_id", "key": "m_key"}))
    base = phrase_places(docs, phrases)
    both = base.join(found, base["doc_id"].eqNullSafe(found["m_doc_id"]) & (base["key"] == found["m_key"]), "left")
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>")))), ",")
        .alias("labels"),
        F.greatest(F.coalesce("cover", F.lit(0.0)), F.when(F.col("n_base") > 0, base_score).otherwise(0.0)).alias("score"))
