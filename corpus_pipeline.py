"""Corpus pipeline: quality rules, near-dedup, substring dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; all but
the last return the columns of ``documents``.

quality     documents the quality rules reject go
near_dedup  of documents that near-duplicate links connect (five-word shingles, a
            similarity of 0.8 or more), the smallest doc_id stays
substrings  words in runs of 35 that are found again anywhere go; a text that loses
            none is left as it is, others are their words joined by one space
mixing      documents are repeated or left out so that sources come near their targets
tokens      every text gets its ids, and the text decoded from these

Null and empty texts have no words: the quality rules reject them.  A null doc_id
counts as the largest, and rows of a null or a repeated doc_id stay or go by their
texts: a row goes only if its text is a copy or near copy of one that stays.  Of
equal doc_ids and words, one row stays; ties between texts go by their digest.  A
null lang is a language of its own and a null source the last source.  Very long texts
are worked on whole.  An empty table goes through all stages.  Columns besides those of
``documents`` pass through to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagram.llm import anchors, mixing, quality, sentencepiece, simhash
from lineagram.llm.common import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judge(docs).where("kept").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs).select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    got = anchors.remove(docs)
    changed = F.col("n_removed") > 0
    got = got.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return got.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    got = sentencepiece.encode_decode(docs)
    return got.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


#: (name, function of (spark, docs, sf_dir)); each stage's result is the next one's docs.
STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substrings", substring_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: Quality references, fingerprints and token ids aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
