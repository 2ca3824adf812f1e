"""From documents to token ids: language, exact copies, near copies, benchmark passages, encoding.

Each stage works on all rows that the stage before it kept, written as Parquet and read again. All but the last return
the columns of `documents`.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from callmeter.llm import bpe_codec, decontaminate, exact_dedup, jaccard_join, lang_id
from callmeter.llm.common import remainder, shared_dir


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what has no learned language: null texts, texts without a letter, and long ones near no prototype."""
    return lang_id.has_language(docs, lang_id.train(docs.filter(remainder("doc_id", 5) != 0)))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest stays, then the smallest doc_id."""
    return exact_dedup.keep_one(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 on five-word shingles, the smallest doc_id stays."""
    return jaccard_join.keep_representatives(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and checksums of the ids and of what they decode to."""
    return bpe_codec.digests(docs, public_tokenizers.path(bpe_codec.RANKS), keep_ids=True)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", no_copies),
    ("near_dedup", no_near_copies),
    ("decontaminate", no_benchmark),
    ("bpe", token_ids),
]

#: No SQL: profiles, edit distances and merges are beyond it; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/callmeter/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
