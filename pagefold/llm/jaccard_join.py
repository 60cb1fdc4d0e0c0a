"""N-gram Jaccard join with adaptive multi-match prefixes (operator 3).

Documents are sets of word shingles, in one global order, rare ones first.
Two sets that are similar enough must share at least l shingles among the
first (size - needed overlap + l) of each, for any l. The plain prefix
filter takes l = 1; here each document takes the l whose longer prefix costs
least, by the estimated number of other documents behind its prefix
shingles. A pair becomes a candidate if it shares the smaller of its two l
within prefixes cut to the overlap that its two sizes need, and is then
verified on the words themselves.

* Equal sets are one class; only classes are joined.
* Frequencies for the order come from one sketch of counts over all
  documents: any order is right, a good one saves candidates. Its size is
  fixed, so it may be broadcast.
* Large groups of near copies are first linked by a few tries a document and
  contracted to components; then all candidate pairs *between* components
  are verified. No link between two components is lost, and no group is
  expanded into all its pairs.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch_path, set_aside, shuffle_partitions, slices, store, texts
from .components import contract
from .words import BLANK_WORDS, batch_gram_hashes, gram_hashes, mix

#: Counters of the frequency sketch, and of one stored piece of it.
SKETCH_BITS = 22
CHUNK = 1 << 14
#: Texts whose shingles are computed in one go, so that their hashes stay in a processor's own memory.
SET_TEXTS = 32
#: Most shared prefix shingles that a document may ask for.
MOST_MATCHES = 4

SET_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("sig", T.StringType()),
    T.StructField("chunk", T.IntegerType()),
    T.StructField("counts", T.BinaryType()),
])
CHUNK_SCHEMA = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("counts", T.BinaryType())])
PREFIX_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("sig", T.StringType()),
    T.StructField("n", T.IntegerType()),
    T.StructField("matches", T.IntegerType()),
    T.StructField("plain", T.IntegerType()),
    T.StructField("prefix", T.ArrayType(T.LongType())),
])
LINK_SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def shingle_sets(contents: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: runs of ``k`` words, or all words as one if there are fewer."""
    out = []
    for i in range(0, len(contents), SET_TEXTS):
        found = [t.encode("utf-8", "surrogatepass").translate(BLANK_WORDS) for t in contents[i:i + SET_TEXTS]]
        for words, grams in batch_gram_hashes(found, k):
            if 0 < len(words) < k:
                out.append(mix(gram_hashes(words, len(words)) + np.uint64(len(words))))
                continue
            grams = np.sort(grams)
            new = np.ones(len(grams), dtype=bool)
            new[1:] = grams[1:] != grams[:-1]
            out.append(grams[new])
    return out


def word_shingles(text: str, k: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves, for exact verification."""
    words = text.encode("utf-8", "surrogatepass").translate(BLANK_WORDS).split()
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(k))))


def signature(shingles: np.ndarray) -> str:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest()


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any set that is similar by ``percent``."""
    return -(-percent * n // 100)


def best_matches(cost: np.ndarray, plain: int, n: int) -> int:
    """The number of shared prefix shingles to ask for, by estimated cost.

    ``cost`` are the estimated other documents behind each shingle in order.
    A prefix that asks for l matches scans its postings once, and at most a
    l-th part of them are candidates, each verified in time of the set.
    """
    most = min(MOST_MATCHES, n - plain + 1)
    scanned = np.cumsum(cost[: plain + most - 1])[plain - 1:]
    return 1 + int(np.argmin(scanned * (1 + n / 16 / np.arange(1, most + 1))))


def document_sets(docs: DataFrame, k: int) -> DataFrame:
    """Of every document its set size and signature; and, as rows of their own, the counts of the sketch by task.

    A task counts to 255 at most for a counter, in a compressed byte each:
    what is counted higher is frequent in any case.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for b in slices(batches):
            sets = shingle_sets(b["text"].to_pylist(), k)
            if sets:
                np.add.at(total, (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([
                b["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.string()),
                pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], SET_SCHEMA.names)
        codec = pa.Codec("zstd", 1)
        pieces = np.minimum(total, 255).astype(np.uint8).reshape(-1, CHUNK) if total.any() else ()
        n = len(pieces)
        yield pa.RecordBatch.from_arrays([
            pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array(range(n), pa.int32()),
            pa.array([codec.compress(p.tobytes(), asbytes=True) for p in pieces], pa.binary())], SET_SCHEMA.names)

    return texts(docs).mapInArrow(run, SET_SCHEMA)


def sketch(sets: DataFrame) -> np.ndarray:
    """The summed sketch: a fixed number of counters, whatever the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, codec = None, None, pa.Codec("zstd", 1)

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), pa.array([np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())],
                CHUNK_SCHEMA.names)

        for b in batches:
            for chunk, counts in zip(b["chunk"].to_pylist(), b["counts"].to_pylist()):
                if chunk != at:
                    if at is not None:
                        yield close()
                    at, total = chunk, np.zeros(CHUNK, dtype=np.int64)
                total += np.frombuffer(codec.decompress(counts, CHUNK), dtype=np.uint8)
        if at is not None:
            yield close()

    out = np.zeros((1 << SKETCH_BITS) // CHUNK * CHUNK, dtype=np.uint32).reshape(-1, CHUNK)
    parts = sets.filter("chunk is not null").select("chunk", "counts").repartition("chunk").sortWithinPartitions("chunk")
    for row in parts.mapInArrow(run, CHUNK_SCHEMA).collect():
        out[row["chunk"]] = np.frombuffer(row["counts"], dtype="<u4")
    return out.reshape(-1)


def prefixes(docs: DataFrame, counts: np.ndarray, k: int, percent: int) -> DataFrame:
    """Signature, set size, matches asked for, plain prefix length and prefix of every document with words."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(counts)
    noise = float(counts.sum(dtype=np.int64)) / len(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in slices(batches):
            rows = []
            for key, s in zip(b["doc_id"].to_pylist(), shingle_sets(b["text"].to_pylist(), k)):
                n = len(s)
                if n:
                    often = table[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    order = np.lexsort((s, often))
                    plain = n - needed(n, percent) + 1
                    matches = best_matches(np.maximum(often[order] - noise, 0.0), plain, n)
                    rows.append((key, signature(s), n, matches, plain, s[order[: plain + matches - 1]].view(np.int64)))
            cols = list(zip(*rows)) or [()] * 6
            ends = np.cumsum([0, *(len(p) for p in cols[5])]).astype(np.int32)
            flat = pa.array(np.concatenate(cols[5]) if rows else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([
                pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), *(pa.array(c, pa.int32()) for c in cols[2:5]),
                pa.ListArray.from_arrays(pa.array(ends), flat)], PREFIX_SCHEMA.names)

    return texts(docs).mapInArrow(run, PREFIX_SCHEMA)


def shared_entries(classes: DataFrame) -> DataFrame:
    """Index entries (``token``, ``node``, ``n``, ``matches``, ``pos``) of tokens that two classes or more have."""
    # the three small numbers travel as one: size, place and matches
    entries = classes.select("node", "n", "matches", F.posexplode("prefix").alias("pos", "token")).select(
        "token", "node", F.expr("shiftleft(bigint(n), 32) | shiftleft(bigint(pos), 4) | matches").alias("packed"))
    per = Window.partitionBy("token")
    return entries.withColumn("many", F.count("*").over(per)).filter("many > 1").select(
        "token", "node", F.expr("int(shiftright(packed, 32))").alias("n"), F.expr("int(packed & 15)").alias("matches"),
        F.expr("int(shiftright(packed, 4) & 268435455)").alias("pos"))


def neighbour_pairs(entries: DataFrame, turn: int, most: int) -> DataFrame:
    """For each node up to ``most`` nodes of other components that share prefix tokens with it.

    The entries of each token are put in a random order of their own, and
    another one each ``turn``; neighbours there become pairs, two an entry at
    most, and of its pairs a node keeps those that share most tokens. So the
    pairs grow with the entries, whatever the size of a group; in a large
    group of near copies a few of them suffice to connect nearly all.
    """
    mixed = Window.partitionBy("token").orderBy(F.xxhash64(F.lit(turn), "token", "node"), "node")
    other = lambda k: F.struct(*[F.lag(c, k).over(mixed).alias(c) for c in ("node", "component", "n")])
    met = (entries.select("node", "component", "n", "percent", F.array(other(1), other(2)).alias("o"))
           .select("node", "component", "n", "percent", F.explode("o").alias("o"))
           .filter((F.col("component") != F.col("o.component")) & _sizes_fit("n", "o.n")))
    shared = met.groupBy(F.col("node").alias("a"), F.col("o.node").alias("b")).agg(F.count("*").alias("c"))
    first = Window.partitionBy("a").orderBy(F.desc("c"), F.xxhash64(F.lit(turn), "b"), "b")
    return shared.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= most).select("a", "b")


def _sizes_fit(a: str, b: str, percent: str = "percent") -> Column:
    return (F.col(a) * 100 >= F.col(b) * F.col(percent)) & (F.col(b) * 100 >= F.col(a) * F.col(percent))


def _overlap(a: Column, b: Column) -> Column:
    """Least overlap of similar sets of the sizes ``a`` and ``b``."""
    return F.ceil(F.col("percent") * (a + b) / (F.col("percent") + 100))


def cross_entries(entries: DataFrame) -> DataFrame:
    """The ``entries`` that can serve a link between components, with ``met`` and whether they are of the ``main`` component.

    A token that only one component has is in no other, neither in its
    prefixes nor behind them: what stands before a shared token in one
    prefix, and is in the other set, stands before it there too. So of the
    tokens before an entry only the ``met`` ones, which another component
    has as well, can be shared, and a set that has lost too many of them is
    similar to no set of the sizes that the token has. In a large group of
    copies this takes out the members that differ from all others, whose
    entries would meet the whole group. No entry of a link is lost.
    """
    sizes = entries.groupBy("token", "component").agg(F.count("*").alias("c"), F.min("n").alias("low"))
    main = sizes.groupBy("token").agg(F.max(F.struct("c", "component"))["component"].alias("main"),
                                      F.min("low").alias("low"), F.count("*").alias("k"))
    marked = entries.join(main.filter("k > 1").drop("k"), "token")
    ranked = marked.withColumn("met", F.row_number().over(Window.partitionBy("node").orderBy("pos")) - 1)
    smallest = F.greatest("low", F.ceil(F.col("n") * F.col("percent") / 100))
    return (ranked.filter(F.col("n") - F.col("pos") + F.col("met") >= _overlap(F.col("n"), smallest))
            .withColumn("main", F.col("component") == F.col("main")).drop("low"))


def cross_pairs(entries: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidate pairs between components: those that share enough tokens of their prefixes.

    Two sizes together need a larger overlap than either needs alone, so a
    pair is looked for in shorter prefixes than the stored ones: long enough
    for the matches that both documents ask for. A pair of l matches is met
    at the l-th of them or later, so an entry serves it only with l - 1
    ``met`` tokens before it, and only where what stands behind it, and may
    be shared before it, reaches the overlap. The distinct pairs met like
    this are then counted on their prefixes. Within the entries of a token
    the component with most of them is not joined with itself, so a group
    that is already linked costs its length, not its square.
    """
    open_entries = store(cross_entries(entries), "cross-entries")
    left, right = (open_entries.select("token", "percent", *[F.col(c).alias(f"{c}_{s}") for c in
                   ("node", "n", "matches", "pos", "met", "component", "main")]) for s in "xy")
    ask = F.least("matches_x", "matches_y")
    both = _overlap(F.col("n_x"), F.col("n_y"))
    near = [F.col(f"pos_{s}") < F.col(f"n_{s}") - both + ask for s in "xy"]
    before = F.least("met_x", "met_y")
    reach = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) + before >= both
    met = (left.filter("not main_x").join(right.drop("percent"), "token")
           .filter((F.col("component_x") != F.col("component_y")) & (F.col("main_y") | (F.col("node_x") < F.col("node_y")))
                   & (before >= ask - 1) & _sizes_fit("n_x", "n_y") & near[0] & near[1] & reach))
    pairs = met.select("percent", F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()
    for s, end in zip("xy", "ab"):
        pairs = pairs.join(classes.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "matches", "prefix")]), end)
    cut = [F.slice(f"prefix_{s}", F.lit(1), (F.col(f"n_{s}") - both + ask).cast("int")) for s in "xy"]
    return pairs.filter(F.size(F.array_intersect(*cut)) >= ask).select("a", "b")


def verified(pairs: DataFrame, contents: DataFrame, k: int, percent: int) -> DataFrame:
    """The ``pairs`` whose word shingles are similar enough; ``contents`` has a text of each signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in slices(batches, 64):
            a, b = [], []
            for x, y, s, t in zip(*(batch[c].to_pylist() for c in ("a", "b", "text_a", "text_b"))):
                if y != last:
                    last, held = y, word_shingles(t, k)
                other = word_shingles(s, k)
                both = len(held & other)
                if 100 * both >= percent * (len(held) + len(other) - both):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], LINK_SCHEMA.names)

    one = pairs.join(contents.select(F.col("sig").alias("sig_a"), F.col("text").alias("text_a")), "sig_a")
    heads = pairs.select(F.col("sig_b").alias("sig")).distinct().join(contents, "sig")
    two = one.join(heads.select(F.col("sig").alias("sig_b"), F.col("text").alias("text_b")), "sig_b").sortWithinPartitions("b")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(run, LINK_SCHEMA)


def bucketed(contents: DataFrame) -> DataFrame:
    """``contents`` stored in buckets of ``sig``, so that joins on it move only their other side."""
    spark = contents.sparkSession
    name, n = f"llm_texts_{uuid.uuid4().hex}", shuffle_partitions(spark)
    (contents.write.bucketBy(n, "sig").sortBy("sig")
     .option("path", scratch_path(spark, "shingle-texts")).saveAsTable(name))
    return spark.table(name)


def join(docs: DataFrame, k: int = 5, percent: int = 80, rounds: int = 2, partners: int = 16) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of ``percent`` or more of their ``k``-word shingles.

    Returns a row for each row of ``docs``: ``doc_id``, ``sig`` (signature of
    its set), ``n_shingles`` and ``component_id``, the smallest ``doc_id``
    that links reach. Null, empty and wordless texts have an empty set and
    are linked with nothing; texts of fewer words are one shingle; repeated
    rows have equal sets and so one group; other columns are ignored; an
    empty table gives no rows. ``rounds`` in which each node tries a few
    ``partners`` precede the join of all remaining candidates; neither number
    changes the result.
    """
    sets = store(document_sets(docs, k), "shingle-sets")
    rows = sets.filter("chunk is null").select("doc_id", "n", "sig")
    found = prefixes(docs, sketch(sets), k, percent)
    classes = store(found.groupBy("sig").agg(
        F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "matches", "plain", "prefix")],
    ).withColumn("node", F.monotonically_increasing_id()), "shingle-classes")
    entries = store(shared_entries(classes), "shared-entries")
    # one text of each class that has a shared entry, moved once and kept in buckets for all verifications
    signed = store(entries.select("node").distinct().join(classes.select("node", "sig"), "node"), "shingle-nodes")
    keyed = with_signature(docs.select("text"), k).select("sig", F.coalesce("text", F.lit("")).alias("text"))
    contents = bucketed(keyed.dropDuplicates(["sig"]).join(signed, "sig", "left_semi"))
    ends = [signed.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab"]
    grouped = None
    for turn in range(rounds + 1):
        part = entries.withColumn("component", F.col("node")) if grouped is None else (
            entries.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node")))
        part = part.withColumn("percent", F.lit(percent))
        pairs = neighbour_pairs(part, turn, partners) if turn < rounds else cross_pairs(part, classes)
        links = store(verified(store(pairs.join(ends[0], "a").join(ends[1], "b"), "shingle-pairs"), contents, k, percent), "shingle-links")
        grouped = contract(links, grouped)
    reach = classes.select("node", "sig", "doc_id").join(grouped, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    least = reach.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = reach.join(least, "component").select(F.col("sig").alias("class"), "component_id")
    return (rows.join(of_class, (rows["sig"] == of_class["class"]) & (rows["n"] > 0), "left")
            .select("doc_id", "sig", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def with_signature(docs: DataFrame, k: int) -> DataFrame:
    """``docs`` with the signature of each document's shingle set as ``sig`` and an unset ``text`` read as empty."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets([t or "" for t in b["text"].to_pylist()], k)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array([signature(s) for s in sets], pa.string())],
                                             [*names, "sig"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("sig", T.StringType())]))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near copies, that of the smallest ``doc_id``, with its own columns.

    Rows without words have no group and all stay; rows without a ``doc_id``
    stay once for each set if their group has no ``doc_id`` at all.
    """
    groups = join(docs, k, percent)
    keep = (groups.filter((F.col("n_shingles") > 0) & F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("doc_id").alias("keep_id"), F.col("sig").alias("keep_sig")).distinct())
    rows, restore = set_aside(docs, "sig", "keep_id", "keep_sig")
    keyed = with_signature(rows, k)
    empty = signature(np.zeros(0, dtype=np.uint64))
    first = (keyed.filter(F.col("sig") != empty)
             .join(keep, F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("sig") == F.col("keep_sig")), "left_semi")
             .dropDuplicates(["doc_id", "sig"]))
    return restore(first.unionByName(keyed.filter(F.col("sig") == empty)))
