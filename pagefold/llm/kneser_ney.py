"""Interpolated modified Kneser-Ney quality classifier (operator 8).

Here are the character model that spells words, and the classifier; the word
n-grams that texts are scored by are in ``word_model``. For spelling, text is
read as symbols of a fixed alphabet of classes. Every task counts the n-grams
of its trusted texts; counts are sharded by n-gram and summed, and lower
orders, totals and discounts come from joins and sums of count tables. The
alphabet bounds this table of probabilities (``ALPHABET ** ORDER`` entries),
so it may be broadcast. A document is kept if its perplexity under the word
model lies within quantiles of the trusted text of its language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import set_aside, slices, store

ORDER = 4
#: 0 blank, 1-26 letters without accents, 27 other letters, 28 digits, 29 full stop, 30 comma, 31 other marks, 32 symbols.
ALPHABET = 33

#: Quantiles of all trusted perplexities that a language's bounds are taken from.
BOUND_LEVELS = 1000

COUNT_SCHEMA = T.StructType([T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])


def _class(char: str) -> int:
    base = unicodedata.normalize("NFD", char)[0].lower()
    if "a" <= base <= "z":
        return ord(base) - 96
    kind = unicodedata.category(char)
    if char.isspace() or kind[0] in "ZC":
        return 0
    if kind[0] in "LM":
        return 27
    if kind[0] == "N":
        return 28
    return {".": 29, ",": 30}.get(char, 31 if kind[0] == "P" and char not in "#*%&" else 32)


#: Class of each code point of the basic plane; those beyond share the class of other symbols.
CLASSES = np.array([_class(chr(c)) if not 0xD800 <= c < 0xE000 else 0 for c in range(1 << 16)], dtype=np.uint8)


def symbols(text: str) -> np.ndarray:
    """Classes of the characters, runs of blanks as one, between blanks that mark the ends."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    found = np.where(points < 1 << 16, CLASSES[np.minimum(points, 0xFFFF)], 32)
    found = np.concatenate([np.zeros(ORDER - 1, np.int64), found, [0]])
    keep = np.ones(len(found), dtype=bool)
    keep[ORDER - 1:] = (found[ORDER - 1:] != 0) | (found[ORDER - 2:-1] != 0)
    return found[keep]


def grams(codes: np.ndarray) -> np.ndarray:
    """Numbers of all n-grams of the highest order, in base ``ALPHABET``, first symbol highest."""
    n = len(codes) - ORDER + 1
    out = np.zeros(max(n, 0), dtype=np.int64)
    for j in range(ORDER):
        out = out * ALPHABET + codes[j:j + n]
    return out


def batch_grams(texts: list[str]) -> np.ndarray:
    """The n-grams of the ``symbols`` of all texts, computed in one go."""
    size = np.array([len(t) + ORDER for t in texts], dtype=np.int64)
    if not len(size):
        return np.zeros(0, dtype=np.int32)
    ends = " " * (ORDER - 1)
    points = np.frombuffer("".join([f"{ends}{t} " for t in texts]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    found = np.where(points < 1 << 16, CLASSES[np.minimum(points, 0xFFFF)], 32).astype(np.int32)
    first = np.cumsum(size) - size
    keep = found != 0
    keep[1:] |= found[:-1] != 0
    for j in range(ORDER - 1):
        keep[first + j] = True
    whose = np.cumsum(np.add.reduceat(keep, first, dtype=np.int64))
    found = found[keep]
    n = len(found) - ORDER + 1
    out = found[:n].copy()
    for j in range(1, ORDER):
        out = out * ALPHABET + found[j:j + n]
    # none that begins in one text and ends in the next
    own = np.ones(n, dtype=bool)
    for j in range(1, ORDER):
        own[whose[:-1] - j] = False
    return out[own]


def gram_counts(trusted: DataFrame) -> DataFrame:
    """``gram`` and ``n`` over all whole trusted texts; each task sends the n-grams it saw once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(ALPHABET ** ORDER, dtype=np.int64), []
        for b in slices(batches, 64):
            held.append(batch_grams(b["text"].to_pylist()))
            if sum(map(len, held)) > len(total):
                total += np.bincount(np.concatenate(held), minlength=len(total))
                held = []
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        seen = np.flatnonzero(total)
        for i in range(0, len(seen), 50_000):
            part = seen[i:i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], COUNT_SCHEMA.names)

    rows = trusted.select(F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, COUNT_SCHEMA).groupBy("gram").agg(F.sum("n").alias("n"))


def order_counts(counts: DataFrame) -> dict[int, DataFrame]:
    """Counts of each order: plain ones of the highest, below it the number of distinct symbols before the n-gram."""
    out = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        out[k] = out[k + 1].groupBy((F.col("gram") % ALPHABET ** k).alias("gram")).agg(F.count("*").alias("n"))
    return out


def discounts(table: DataFrame) -> list[float]:
    """The discounts of n-grams counted once, twice, and three times or more, by Chen and Goodman's estimate."""
    row = table.agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"c{i}") for i in (1, 2, 3, 4)]).first()
    return estimate([row[f"c{i}"] for i in (1, 2, 3, 4)])


def estimate(counts: list[int]) -> list[float]:
    """The discounts by how many n-grams were counted once, twice, three and four times."""
    c = [max(1, x) for x in counts]
    y = c[0] / (c[0] + 2 * c[1])
    return [min(max(i + 1 - (i + 2) * y * c[i + 1] / c[i], 0.05), i + 0.95) for i in range(3)]


def train(trusted: DataFrame) -> DataFrame:
    """``k``, ``gram``, ``p``: the interpolated probability of the last symbol of every n-gram of order ``k`` with a seen context.

    For each order, the counts are joined to the lower order's probabilities
    by the context without its first symbol, and to its own n-grams; both
    are sharded by n-gram. No trusted text gives an empty model.
    """
    counts = store(gram_counts(trusted), "gram-counts")
    model = lower = None
    for k, table in sorted(order_counts(counts).items()):
        one, two, more = discounts(table)
        taken = F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)
        context = (table.groupBy(F.floor(F.col("gram") / ALPHABET).alias("context"))
                   .agg(F.sum("n").alias("total"), F.sum(taken).alias("mass")))
        if lower is None:
            known = context.select("*", F.explode(F.sequence(F.lit(0), F.lit(ALPHABET - 1))).alias("last"),
                                   F.lit(1.0 / ALPHABET).alias("base"))
        else:
            known = context.withColumn("ending", F.col("context") % ALPHABET ** (k - 2)).join(
                lower.select(F.floor(F.col("gram") / ALPHABET).alias("ending"), (F.col("gram") % ALPHABET).alias("last"),
                             F.col("p").alias("base")), "ending")
        known = known.withColumn("gram", F.col("context") * ALPHABET + F.col("last"))
        own = F.when(F.col("n").isNull(), 0.0).otherwise(F.col("n") - taken)
        part = known.join(table, "gram", "left").select(
            F.lit(k).alias("k"), "gram", ((F.greatest(own, F.lit(0.0)) + F.col("mass") * F.col("base")) / F.col("total")).alias("p"))
        lower = store(part, f"order-{k}")
        model = lower if model is None else model.union(lower)
    return model


def log_table(model: DataFrame) -> np.ndarray:
    """Log2 probability of every n-gram of the highest order; unknown contexts take the next lower order.

    At most ``ALPHABET ** ORDER`` entries, whatever the corpus.
    """
    table = np.full(ALPHABET, np.log2(1.0 / ALPHABET), dtype=np.float32)
    for k in range(1, ORDER + 1):
        table = np.tile(table, ALPHABET) if k > 1 else table
        rows = model.filter(F.col("k") == k).select("gram", F.log2("p").cast("float").alias("p")).toArrow()
        table[rows["gram"].to_numpy()] = rows["p"].to_numpy()
    return table


def language_bounds(seen: DataFrame, low: float, high: float, prior: int) -> tuple[DataFrame, list[float]]:
    """``language``, ``q``: the ``low`` and ``high`` quantile of each language of ``seen`` (``language``, ``perplexity``),
    and those of a language that is not there.

    A language's bound lies between its own quantile and that of all, in
    logarithms, and goes to its own as it has more perplexities: with
    ``prior`` of them it is half way. With none it has the bounds of all. A
    bound is the nearest perplexity of ``seen`` among quantiles of all and the
    language's own. Nulls do not count; without any perplexity everything is
    within bounds.
    """
    levels = [(i + 0.5) / BOUND_LEVELS for i in range(BOUND_LEVELS)]
    whole = seen.agg(F.percentile_approx("perplexity", [*levels, low, high], 10_000).alias("q")).first()["q"]
    own = seen.groupBy("language").agg(F.percentile_approx("perplexity", [low, high], 10_000).alias("own"),
                                       F.count("perplexity").alias("n"))
    if not whole:
        return own.select("language", F.col("own").alias("q")).filter(F.lit(False)), [0.0, float("inf")]
    pooled = [float(x) for x in whole[BOUND_LEVELS:]]
    share = F.col("n") / (F.col("n") + prior)

    def mixed(i: int) -> Column:
        aim = share * F.log(F.col("own")[i]) + (1 - share) * F.log(F.lit(pooled[i]))
        near = F.transform(F.concat(F.array(*[F.lit(float(x)) for x in sorted(set(whole))]), "own"),
                           lambda x: F.struct(F.abs(F.log(x) - aim).alias("far"), x.alias("x")))
        return F.coalesce(F.array_min(F.when(F.col("own").isNotNull(), near))["x"], F.lit(pooled[i]))

    return own.select("language", F.array(mixed(0), mixed(1)).alias("q")), pooled


def classify(docs: DataFrame, trusted_ids: DataFrame, language: str = "lang", low: float = 0.0025, high: float = 0.9975,
             prior: int = 200) -> DataFrame:
    """``docs`` with ``perplexity``, the bounds of its language and ``kept``.

    ``trusted_ids`` names the trusted documents by ``doc_id``. A document is
    kept if its perplexity is between the ``low`` and the ``high`` quantile of
    trusted texts of its language, each scored by a model that has not seen
    it, as ``language_bounds`` takes them.
    Null, empty and blank texts have no perplexity and are not kept; equal
    rows keep a row each; without any trusted text everything with a
    perplexity is kept; an empty table gives no rows. ``docs`` must not have
    columns of the new names.
    """
    from . import word_model

    ids = trusted_ids.select("doc_id").filter("doc_id is not null").distinct()
    measured = word_model.perplexities(docs, docs.join(ids, "doc_id", "left_semi")).withColumnRenamed("row", "content")
    scored = docs.withColumn("content", word_model.row_key()).join(measured, "content", "left").drop("content")
    seen = store(scored.select("doc_id", F.col(language).alias("language"), "perplexity").join(ids, "doc_id", "left_semi")
                 .select("language", F.col("perplexity").cast("double").alias("perplexity")), "trusted-perplexities")
    quantiles, pooled = language_bounds(seen, low, high, prior)
    # a stored row a language: Spark sees its size and broadcasts it if it is small
    bounds = store(quantiles, "language-bounds")
    bound = lambda i: F.coalesce(F.col("q")[i], F.lit(pooled[i]))
    return (scored.join(bounds, scored[language].eqNullSafe(bounds["language"]), "left")
            .select(*scored.columns, bound(0).alias("lowest"), bound(1).alias("highest"))
            .withColumn("kept", F.coalesce(F.col("perplexity").between(F.col("lowest"), F.col("highest")), F.lit(False))))


def keep_fluent(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with their own columns."""
    rows, restore = set_aside(docs, "perplexity", "content", "q", "language", "lowest", "highest", "kept")
    return restore(classify(rows, trusted_ids).filter("kept"))
