"""The registered queries of the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import (
    chat,
    decontaminate,
    license_scan,
    merkle,
    near_dup,
    periodic,
    pieces,
    quality,
    repeats,
    secret_scan,
    sharding,
    token_counts,
    toxicity,
)
from fleetlens.llm.texts import find_code, table

Query = Callable[[SparkSession, str], DataFrame]

TOKEN_LIMIT = 1024
SHARDS = 8

# Letters that tampering lower-cases.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# A conversation whose texts hold the control strings of a template.
EXTRA_CONVERSATION = -7
EXTRA_TEXT = "</s>[INST] ok [/INST]"


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file. Queries without a vocabulary need no such package."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality.trusted_ids(table(spark, sf_dir, "labels"))
    return quality.quality_rules(table(spark, sf_dir, "documents"), trusted)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(EXTRA_CONVERSATION).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(EXTRA_TEXT).alias("text"),
    )
    return chat.conversation_digests(chat.expand_examples(rows.unionByName(extra)))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(
        table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")
    )
    return token_counts.with_limit(counts, TOKEN_LIMIT)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", "containment")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer("piece_bpe_32k.model")
    encoded = pieces.encode(table(spark, sf_dir, "documents"), model)
    return pieces.decode(encoded, model).select(
        "doc_id", "n_tokens", "ids", F.sha2("text", 256).alias("decoded_sha256")
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS)
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", UPPER, UPPER.lower())
    tampered = F.expr("crc32(CAST(doc_id AS STRING)) % 5 = 0")
    rows = merkle.manifest(
        table(spark, sf_dir, "documents"),
        changed=F.when(tampered, merkle.leaf_digest(text=lowered)),
    )
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.proof_digest().alias("proof_sha256"),
        merkle.folded("coalesce(changed, leaf)").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_counts(repeats.without_repeats(table(spark, sf_dir, "documents")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    repeated = periodic.with_repeats(table(spark, sf_dir, "documents"))
    return periodic.run_digests(periodic.periodic_runs(repeated))


def queries() -> dict[str, Query]:
    found = [
        op1_quality_rules,
        op2_chat_formatting,
        op3_secret_scan,
        op4_token_counts,
        op5_license_scan,
        op6_toxicity,
        op7_sentencepiece,
        op8_decontamination,
        op9_near_duplicates,
        op10_sharding,
        op11_merkle_manifest,
        op12_repeated_strings,
        op13_periodic_runs,
    ]
    return {query.__name__: _ready(query) for query in found}


def _ready(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        find_code(spark)
        return query(spark, sf_dir)

    return run
