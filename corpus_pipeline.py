"""The corpus pipeline: five operators of pointloom.llm, one after another over documents.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs.  Stages but the last return the columns of
documents; the last returns the digests of the encoded texts.  SQL can express neither the first nor the fourth stage,
so the tests hold each stage against a brute-force version instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import bpe, decontaminate, ngram, pii, quality
from pointloom.llm.common import forget, kept, mark, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the labelled lines reject go."""
    return quality.passing(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays."""
    return ngram.distinct(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are encoded and decoded again; the result has a row per document."""
    return bpe.digests(docs, bpe.default_vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: SQL can't express the labelling field of the first stage, nor the trees of the fourth.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        since = mark()
        before, docs = docs, kept(stage(spark, docs, sf_dir), name)
        forget(spark, since - hasattr(before, "kept_at"), docs)  # with what the stage read, if that was a stage's
    return STAGES[-1][1](spark, docs, sf_dir)
