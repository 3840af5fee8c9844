"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written and read back.
A stage works on all rows that its predecessor kept. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm._common import materialize, table
from tidewatch.llm.exact_dedup import exact_dedup
from tidewatch.llm.language_id import keep_known_language
from tidewatch.llm.minhash_dedup import near_dedup
from tidewatch.llm.mixing import mix
from tidewatch.llm.sentencepiece_codec import sp_digests


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter or without a language that the network is at all sure of."""
    return keep_known_language(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 or more, the one with the smallest doc_id stays."""
    return near_dedup(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or one to three times."""
    return mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row of the mix: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return sp_digests(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_duplicates), ("near_dedup", near_duplicates), ("mix", mix_sources), ("sentencepiece", encode)]
#: SQL can express neither the network nor the vocabulary; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
