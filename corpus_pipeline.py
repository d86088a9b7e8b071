"""Corpus pipeline: raw documents to a tokenized, deduplicated, mixed training set.

``STAGES`` lists (name, function) in order. Each function takes (spark, docs,
sf_dir) and returns a DataFrame; what a stage returns is written as Parquet and
read again as the next one's docs. All stages but the last return the columns of
``documents``. Near-duplicates take five words and a similarity of 0.8.

1. language_id   documents without a language go, missing languages are filled in
2. exact_dedup   of equal texts the one with the smallest id stays
3. near_dedup    of each near-duplicate group the one with the smallest id stays
4. mixing        documents in training order, as often as the mix takes each
5. bpe           token ids, with digests of the ids and of the decoded text
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from innsight.llm import bpe, exact_dedup, language, mixing, near_dedup
from innsight.llm.tables import materialize, read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.training_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, bpe.vocabulary_path(), keep_ids=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mix),
    ("bpe", encode),
]

# the stages hold trained models and a tokenizer, which SQL can't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
