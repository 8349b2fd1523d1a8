"""A corpus pipeline: toxicity, exact copies, near copies, mixing sources to weights, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of the documents; the last one returns the digests of every row's tokens.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from assayer.llm.common import shared_dir


def ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, with their columns; null and empty texts stay, repeated rows alike. Labels are
    those of the labels table; an empty table gives an empty result."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the smallest doc_id (null last); null texts count as empty ones."""
    return exact_dedup.drop_copies(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id (null last); all without words."""
    return ngram_join.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it, not at all, once or twice; a null source is the last one, and rows
    without doc_id are drawn by their text."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the tokens and of the decoded text of every row; a null text counts as empty."""
    return bpe.encode_documents(docs, bpe.default_path(), "digest")


STAGES = [
    ("toxicity", ordinary), ("exact dedup", distinct), ("n-gram Jaccard join", dissimilar),
    ("mixing", mixed), ("BPE encoding", encoded),
]

#: Neither the classifier nor the merges of the tokenizer can be put in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; between them rows are written to the shared folder and read again.

    What a stage has read is deleted when its own rows are written; those of the last but one stay, as the result reads them.
    """
    shared_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stages-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            removed(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
