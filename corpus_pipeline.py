"""A training-data pipeline over ``documents``: quality, near duplicates, benchmark, personal data, tokens.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor
kept, and returns a DataFrame that is written as Parquet and read again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe, decontaminate, jaccard, pii, quality
from gridloom.llm.common import read, shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all their columns.

    Null and empty texts have too few words and go; null and repeated keys and
    repeated rows are judged by their texts; an empty table gives an empty one;
    without labels only the base rules decide.
    """
    model = quality.fit_quality(docs, read(spark, sf_dir, "labels"))
    return quality.drop_low_quality(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8), with all its columns.

    Texts without words all stay; of repeated rows one stays; null and repeated
    keys are not looked at; an empty table gives an empty one.
    """
    return jaccard.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, with all their columns.

    Null and empty texts stay; repeated rows go or stay together; items count
    with or without an id; an empty table or benchmark drops nothing.
    """
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"), null_items=True)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind and lengths counted anew.

    Null texts stay null, keys and repeated rows stay as they are, an empty
    table gives an empty one.
    """
    return pii.redact_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the token ids as little-endian 32-bit integers, and the bytes they decode to.

    A row for each document, repeated ones too; a null or empty text has no
    tokens, a null key stays null, an empty table gives an empty one.
    """
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", keep_quality),
    ("ngram_jaccard", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("byte_bpe", tokens),
]

#: The stages fit models and follow links, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    What is between two stages is written to the shared folder, and goes when
    the next stage is written; the last one stays for the result to read.
    """
    shared_folder(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
