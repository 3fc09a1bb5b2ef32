"""From raw documents to packed sequences: five stages over the text operators.

toxicity          documents that score as toxic go
near_duplicates   one document of each group of near copies stays (5-word shingles, similarity 0.8)
repeated_passages words of 20-word windows that start earlier elsewhere go
secrets           spans of secrets are replaced by a mark
packing           what is left is tokenized and packed along the curve, one row per piece

Each stage's result is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from overlook.llm import ngram_join, packing, secret_scan, substring_dedup, toxicity
from overlook.llm.common import discard, materialize, scratch, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeats(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Trained scores, MinHash candidates and token ids have no SQL form; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's own tables go once its result is written, and a result once the next one is."""
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        result: list[str] = []
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, result)
        discard(spark, before)
        before = result
    return STAGES[-1][1](spark, docs, sf_dir)
