"""From raw documents to encoded training data, in five stages over the llm operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to
the shared folder and reads it back as the next stage's docs. All stages but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlens.llm import bpe, langid, mixing, neardup, pii
from gridlens.llm.common import buckets, read_table, staged
from gridlens.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are 'und' (no letter) go, those in a language not learnt stay (see langid.accept); a missing lang is filled in."""
    return langid.accept(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    return neardup.deduplicate(docs, words=5, percent=80)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked, and terms that give it away are generalised or removed."""
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out to meet their sources' target weights, and shuffled in shards."""
    return mixing.mixed(docs, shards=buckets(spark))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document of the mix: its token ids, with their hash and the decoded text's."""
    return bpe.encode_documents(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("pii", sanitise),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Mixtures, sketches and merges have no SQL form; tests hold each stage against a plain version on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs)
    return docs
