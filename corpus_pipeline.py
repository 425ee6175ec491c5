"""Corpus preparation: five stages from raw documents to token ids.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns the rows that go on.  A stage is judged on its own input, and its
result is written as Parquet before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sitepulse.llm import bpe, decontam, exact, langid, simhash
from sitepulse.llm.queries import BPE_FILE
from sitepulse.llm.storage import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language (null, empty, no letter)."""
    return langid.keep_identified(docs, public_tokenizers.path(BPE_FILE))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest id of equal texts."""
    return exact.keep_one(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each group of near copies."""
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item (coverage limit 0)."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the token ids."""
    path = public_tokenizers.path(BPE_FILE)
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language", language),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("byte_bpe", byte_bpe),
]

#: Language models, SimHash and BPE have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
