"""A corpus pipeline: language ID, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
``docs``.  Rows without a doc_id stay until packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonara.llm import language_id, line_dedup, near_dedup, packing
from resonara.llm.common import written
from resonara.plans.scratch import last_folder, releasing


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; only what language ID calls ``und`` goes, whatever the score of the rest."""
    judged = language_id.with_language(docs)
    return judged.where(F.col("lang_pred") != "und").select(*(F.col("own").getField(c).alias(c) for c in docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; lines of 40 characters or more that 5 documents hold stay in the last one only."""
    return line_dedup.without_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more over five-word shingles."""
    return near_dedup.without_near_copies(docs, k=5, percent=80)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their ids and the ids' checksum, in sequences of 2048 tokens."""
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: Language ID, near-dedup and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each result written and read again; what a stage wrote besides is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with releasing(spark) as keep:
            docs = written(stage(spark, docs, sf_dir), name)
            keep.append(last_folder())
    return docs
