"""Secret scans with corpus-wide ownership frequency (operator 5).

Patterns find candidates in every whole text. What tells a live credential
from an example is who has it: the hash of each candidate value is
aggregated over the corpus by distinct owners and repositories. A value that
several owners hold, or two in several repositories, is a widely copied
example; a value of one owner that does not look like a placeholder is taken
for live. Base spans always stay; candidates that only look random become
spans unless they are copied or placeholders: of kind ``live`` if the corpus
says that one owner alone has them, else ``unclear``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import set_aside, slices, store

#: The base patterns, in the order that breaks ties of start.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Any long run of credential characters; a candidate if it mixes letters and digits at random.
RANDOM = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|your|xxxx|0000|1234|test", re.I)

SPAN = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("value_hash", T.StringType()),
    T.StructField("plausible", T.BooleanType()),
])
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                   ("value_hash", pa.string()), ("plausible", pa.bool_())]))


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base matches, by start and then kind as listed."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def random_spans(text: str, base: list[tuple[str, int, int, str]], least_entropy: float) -> list[tuple[str, int, int, str]]:
    """Random-looking runs that touch no base span."""
    out = []
    for m in RANDOM.finditer(text):
        v = m[0]
        if (any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and entropy(v) >= least_entropy
                and not any(s < m.end() and m.start() < e for _, s, e, _ in base)):
            out.append(("live", m.start(), m.end(), v))
    return out


def candidates(docs: DataFrame, least_entropy: float = 3.3) -> DataFrame:
    """All columns of ``docs`` and ``spans``: every candidate of the whole text (null: none), kind ``live`` still unjudged. ``docs`` has no column ``spans``."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            col = []
            for text in b["text"].to_pylist():
                base = base_spans(text or "")
                col.append([{"kind": k, "start": s, "end": e, "value_hash": hashlib.md5(v.encode()).hexdigest(),
                             "plausible": not PLACEHOLDER.search(v) and entropy(v) >= 2.5}
                            for k, s, e, v in base + random_spans(text or "", base, least_entropy)])
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(col, _ARROW_SPANS)], [*names, "spans"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("spans", T.ArrayType(SPAN))]))


def ownership(spans: DataFrame, owner: str, repo: str) -> DataFrame:
    """``value_hash``, ``n_rows``, ``n_repos`` and ``n_owners`` of every candidate value.

    Counted in levels (value, owner, repository), (value, owner), (value):
    the first is summed before its shuffle, so a value that a third of all
    rows hold is a row for each of its repositories when it meets its key.
    """
    return (spans.groupBy("value_hash", F.col(owner).alias("o"), F.col(repo).alias("r")).agg(F.count("*").alias("n_rows"))
            .groupBy("value_hash", "o").agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_repos"))
            .groupBy("value_hash").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_repos").alias("n_repos"),
                                       F.count("*").alias("n_owners")))


def verdict(copied_owners: int, copied_repos: int) -> Column:
    """``copied``: held by ``copied_owners`` owners, or by two or more in ``copied_repos`` repositories together.
    ``live``: one owner's, and no placeholder. ``unclear``: all others."""
    widely = (F.col("n_owners") >= copied_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= copied_repos))
    return F.when(widely, "copied").when((F.col("n_owners") == 1) & F.col("plausible"), "live").otherwise("unclear")


def judged(rows: DataFrame, owner: str, repo: str, copied_owners: int = 3, copied_repos: int = 4) -> DataFrame:
    """``row``, ``kind``, ``start``, ``end``, ``verdict`` and the counts of every span of ``rows`` (with ``spans``).

    Base spans all stay; random ones stay if they are neither copied nor placeholders, under their verdict as kind.
    """
    spans = rows.select("row", owner, repo, F.explode("spans").alias("s")).select("row", owner, repo, "s.*")
    met = spans.join(ownership(spans, owner, repo), "value_hash").withColumn("verdict", verdict(copied_owners, copied_repos))
    base = F.col("kind") != "live"
    return met.filter(base | (F.col("plausible") & (F.col("verdict") != "copied"))).select(
        "row", F.when(base, F.col("kind")).otherwise(F.col("verdict")).alias("kind"), "start", "end", "verdict",
        "n_rows", "n_repos", "n_owners")


def with_identity(docs: DataFrame) -> DataFrame:
    """Owner and repository of a document: its source, and its source and language (own columns of these names are replaced)."""
    return docs.withColumns({"owner": F.col("source"), "repo": F.concat_ws("/", "source", "lang")})


def scan(docs: DataFrame, owner: str = "owner", repo: str = "repo", copied_owners: int = 3,
         copied_repos: int = 4) -> DataFrame:
    """A row a document: ``doc_id``, ``spans`` (base ones, ``live`` and ``unclear`` ones, each with its verdict), in order.

    Null and empty texts have no spans; equal rows keep a row each; null
    owners count as one owner; other columns are ignored; an empty table
    gives no rows. The small table of candidates, not the texts, is stored
    and joined.
    """
    found = candidates(docs.select("doc_id", "text", owner, repo)).drop("text")
    rows = store(found.withColumn("row", F.monotonically_increasing_id()), "secrets")
    kinds = F.array(*[F.lit(k) for k in (*KINDS, "live", "unclear")])
    kept = (judged(rows, owner, repo, copied_owners, copied_repos)
            .groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
                "start", F.array_position(kinds, F.col("kind")).alias("place"), "end", "kind", "verdict", "n_repos", "n_owners",
            ))).alias("spans")))
    return rows.select("row", "doc_id").join(kept, "row", "left").select(
        "doc_id", F.coalesce("spans", F.array().cast(kept.schema["spans"].dataType)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts by base kind, the hash of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"),
                        F.array_join(F.transform("spans", lambda s: s["verdict"]), ",").alias("verdicts"))


def redact(docs: DataFrame, mask: str = "[SECRET]", copied_owners: int = 3, copied_repos: int = 4) -> DataFrame:
    """``docs`` with every span that is not a widely copied example masked in ``text``; ``n_chars`` follows.

    Documents without candidates are passed on as they are; only the others
    meet the verdicts in a join.
    """
    columns = docs.columns
    rows, restore = set_aside(docs, "owner", "repo", "spans", "row", "cuts")
    found = candidates(with_identity(rows))
    clean = restore(found.filter(F.size("spans") == 0))
    held = store(found.filter(F.size("spans") > 0).withColumn("row", F.monotonically_increasing_id()), "secret-docs")
    masked = (judged(held, "owner", "repo", copied_owners, copied_repos).filter(F.col("verdict") != "copied")
              .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts")))
    empty = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, cut: Column) -> Column:
        inside = F.col("text").substr(state["at"].cast("int") + 1, F.greatest(cut["start"] - state["at"], F.lit(0)).cast("int"))
        return F.struct(
            F.when(cut["end"] <= state["at"], state["done"])
            .otherwise(F.concat(state["done"], inside, F.when(cut["start"] >= state["at"], mask).otherwise(""))).alias("done"),
            F.greatest(cut["end"], state["at"]).alias("at"))

    def rest(state: Column) -> Column:
        return F.concat(state["done"], F.col("text").substr(state["at"].cast("int") + 1, F.length("text")))

    joined_rows = held.join(masked, "row", "left")
    text = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.aggregate("cuts", empty, step, rest))
    out = joined_rows.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.unionByName(restore(out))
