"""A pipeline from raw documents to token ids, each stage over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gsig.llm import bpe, line_dedup, mixing, ngram_join, quality
from gsig.llm.common import written

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Columns of docs stay as they are, whatever their names."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    out = quality.classify(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.filter("predicted = 1").select("row.*")


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line are cut."""
    return line_dedup.without_repeats(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies one stays."""
    return ngram_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: documents are left out or repeated."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids of each document of the mix."""
    return bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN).select("doc_id", "source", "n_tokens", "ids")


STAGES = [("quality classifier", good), ("line dedup", fresh_lines), ("n-gram Jaccard join", one_of_each), ("mixing sources", mixed), ("byte-level BPE", encoded)]

#: The classifier is trained and the mix is drawn, which SQL cannot express; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
