"""The numbered queries of the corpus operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_dedup, exact_dedup, hard_negatives, language_id, license_scan, line_dedup, near_dedup, packing, sharding, suffix_dedup, token_counts, whitening

BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_docs(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_docs(spark, sf_dir), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_docs(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(_docs(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_docs(spark, sf_dir), k=2, percent=80)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_docs(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_docs(spark, sf_dir), public_tokenizers.path(WORD_BPE))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction data, where the limit on loss-bearing tokens binds."""
    pieces = packing.pack_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"), public_tokenizers.path(WORD_BPE))
    return pieces.select("conv_id", "turn", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_docs(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_docs(spark, sf_dir))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.9)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_docs(spark, sf_dir)).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_token_counts": op3_token_counts,
    "op4_line_dedup": op4_line_dedup,
    "op5_near_dedup": op5_near_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_packing": op7_packing,
    "packing_of_conversations": op7_conversations,
    "op8_language_id": op8_language_id,
    "op9_license_scan": op9_license_scan,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op5_near_dedup": near_dedup.ORACLE_SQL,
    "op6_exact_dedup": exact_dedup.ORACLE_SQL,
    "op10_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op12_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
