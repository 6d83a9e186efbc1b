"""A corpus pipeline of five stages: quality rules, near-dedup, secret scans, mixing and encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickforge.llm import bpe, mixing, near_dup, quality_rules, secrets
from tickforge.llm.common import Scratch, collected, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and the fences of their language and source."""
    return quality_rules.filter_quality(docs)


#: Near-duplicates are judged on shingles of five words, at a similarity of 0.8.
SHINGLE_WORDS = 5


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    return near_dup.keep_first(docs, words=SHINGLE_WORDS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secret spans replaced by the kind of secret."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each piece of a document in a slot."""
    return mixing.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each row."""
    return bpe.encode(docs)


STAGES = [
    ("quality_rules", drop_low_quality),
    ("near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode_texts),
]

#: Mixing by hashed permutations and byte-pair encoding have no form in SQL; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet and read again for the next. The tables that a stage's
    operator made are dropped once its result is written; those of other results are left alone."""
    docs, written = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        with collected() as made:
            docs = written.put(stage(spark, docs, sf_dir))
        for scratch in made:
            scratch.drop()
    return STAGES[-1][1](spark, docs, sf_dir)
