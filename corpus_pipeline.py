"""From raw documents to packed training sequences.

Five stages, each on all that the one before kept: quality rules and the
quality classifier reject documents, of near copies one document stays,
secrets are masked, and the rest is packed into sequences. Every stage is
written as Parquet in the shared checkpoint folder and read again, so a lost
executor costs no finished stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagefold.llm import jaccard_join, kneser_ney, packing, quality_rules, secret_scan
from pagefold.llm.common import read_table, store, tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that fail the base rule or have a low posterior quality go."""
    return quality_rules.keep_good(docs)


def keep_fluent(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents whose perplexity is outside the bounds of their language go; good labels are the trusted text."""
    return kneser_ney.keep_fluent(docs, read_table(spark, sf_dir, "labels").filter("quality = 1"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group linked by 80 % of common five-word shingles one document stays."""
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: secrets that are no widely copied examples are masked in the text."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: where each piece of each document goes in sequences of at most 1024 ids."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2, width=1024)


STAGES = [
    ("quality_rules", keep_good),
    ("quality_classifier", keep_fluent),
    ("near_copies", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]

#: Tokenization and the language model have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the rows of the last one."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
