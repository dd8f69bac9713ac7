"""A training-data pipeline over ``documents``: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of ``documents``; the last returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import decontaminate, near_dup, pieces, quality, secret_scan
from fleetlens.llm.registry import tokenizer
from fleetlens.llm.texts import find_code, table
from fleetlens.sources.sinks import stage

# Words on a shingle of the near-duplicate stage.
SHINGLE_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    find_code(spark)
    return quality.accepted(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest id, of each near-duplicate group."""
    find_code(spark)
    return near_dup.deduplicated(docs, near_dup.NearDupRules(width=SHINGLE_WORDS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by marks."""
    find_code(spark)
    return secret_scan.redact_secrets(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document."""
    find_code(spark)
    return pieces.encode(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

# SQL has no circulant MinHash, zstandard or SentencePiece. Each stage, and the whole,
# is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each over what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
