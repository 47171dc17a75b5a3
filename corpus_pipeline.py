"""The corpus pipeline: language ID, near-duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept; run() writes each stage's
result to the shared folder and reads it again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import bpe, decontam, jaccard_join, langid, pii
from corpusmill.llm.common import Scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no learned language for sure, go."""
    return langid.language_stage(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 on five-word shingles the least doc_id stays."""
    return jaccard_join.near_duplicate_stage(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontam.decontamination_stage(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind."""
    return pii.redaction_stage(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document left, and the text that decoding the ids gives."""
    return bpe.encode(docs)


STAGES = [("language_id", identify_language), ("jaccard_join", drop_near_duplicates), ("decontamination", decontaminate), ("pii", redact), ("bpe", tokenize)]

#: Trained models and a tokenizer are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(name, stage(spark, docs, sf_dir))
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
