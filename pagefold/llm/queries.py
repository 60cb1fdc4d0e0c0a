"""Registered queries of the training-data operators: thin wrappers that derive the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_trie, density, divergence, jaccard_join, kneser_ney, licenses, packing, quality_rules, secret_scan, spelling, token_files, topk, toxicity
from .common import read_table, scratch_path, tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole document with the word BPE file; digests of ids and decoded text."""
    return bpe_trie.token_digests(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other rows of every vector whose id is divisible by 50."""
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


ORACLES["op2_exact_top_k"] = """
WITH usable AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
scored AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score, c.r AS cr
    FROM usable q JOIN usable c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, cr) AS k FROM scored)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM ranked WHERE k <= 5
"""


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 85 % or more."""
    return jaccard_join.join(read_table(spark, sf_dir, "documents"), k=4, percent=85).select(
        "doc_id", "n_shingles", "component_id")


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole document, write its ids to token files in ``doc_id`` order and read them back."""
    out = scratch_path(spark, "token-files")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), out, end_id=0)
    return token_files.document_digests(spark, out)


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole document, judged by who else in the corpus holds them."""
    docs = secret_scan.with_identity(read_table(spark, sf_dir, "documents"))
    return secret_scan.digests(secret_scan.scan(docs))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learned from the labelled rows that are not held out."""
    labels = read_table(spark, sf_dir, "labels").filter(~toxicity.held_out())
    return toxicity.score(read_table(spark, sf_dir, "documents"), labels).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_hits")


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every whole document and the verdict of the weakly supervised rules."""
    return quality_rules.judge(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every whole document under a model of the documents labelled good, and the verdict of its language."""
    trusted = read_table(spark, sf_dir, "labels").filter("quality = 1")
    return kneser_ney.classify(read_table(spark, sf_dir, "documents"), trusted).select(
        "doc_id", "lang", "perplexity", "lowest", "highest", "kept")


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every whole document into sequences of at most 1024 ids."""
    packed = packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2, width=1024)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and diagonal-voting license labels of every whole document."""
    return licenses.scan(read_table(spark, sf_dir, "documents"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words one edit apart from a word at least twice as frequent, and the end of each chain of such forms."""
    return spelling.variants(read_table(spark, sf_dir, "documents"), least_length=5, least_n=3, times=2, drop_one_in=97)


@query
def op12_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every whole page by composite text density."""
    return density.extract(read_table(spark, sf_dir, "pages"))


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that each source uses beyond its language."""
    return divergence.audit(read_table(spark, sf_dir, "documents"), limit=30, ranks=50)


ORACLES["op13_source_divergence"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
    SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM d),
t AS (
    SELECT r, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS n
    FROM words GROUP BY ALL),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT lang, source, sum(n)::HUGEINT AS s FROM cnt GROUP BY ALL),
p AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
           1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(o.s, 0) + 5 * z.v) AS p
    FROM grp g JOIN kept k USING (lang) JOIN size z USING (lang) LEFT JOIN total o USING (lang, source)
    LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (
    SELECT lang, term, 1 + (1000000000 * (sum(n) + 5)) // (any_value(s) + 5 * any_value(v)) AS q
    FROM cnt JOIN (SELECT lang, sum(s) AS s FROM total GROUP BY ALL) USING (lang) JOIN size USING (lang) GROUP BY ALL),
dist AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN dist ON dist.lang = a.lang AND dist.source = a.source AND dist.item = b.source),
terms AS (
    SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value
    FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS k
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, k::INTEGER AS rank FROM ranked WHERE part = 'pair' OR k <= 50
"""
