"""A corpus pipeline: language ID, exact dedup, near dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir), reads all of ``docs``, and returns the rows that
it keeps with the columns of ``documents`` (the last stage returns packed pieces).
Between stages rows are written as Parquet and read again.

Defined results: an empty table goes through and packs into nothing; of rows repeated
with their doc_id, exact dedup keeps one; a row without doc_id stays unless its text is
null, has no language, or is a copy of a row with one; null texts go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from goldweave.llm import queries
from goldweave.llm.storage import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts, texts without letters, ambiguous texts."""
    from goldweave.llm.language_id import keep_identified

    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of each group of equal texts."""
    from goldweave.llm.exact_dedup import keep_one_copy

    return keep_one_copy(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of near copies (five words, 0.8)."""
    from goldweave.llm.jaccard_join import keep_representatives

    return keep_representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts by their kind; every document stays."""
    from goldweave.llm.secret_scan import redact_secrets

    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 1024 tokens."""
    from goldweave.llm.packing import pack_documents

    return pack_documents(docs, queries.tokenizer_path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", packing),
]

#: SQL can express neither the trained classifier nor the merge rules of the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
