"""A training-data pipeline: each stage takes all rows that the one before kept.

Every stage but the last returns the columns of ``documents``; the last returns one row of token digests for
each document that is left. ``run`` writes each stage as Parquet to the shared folder and reads it again.
No stage can be stated in SQL; tests hold each against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import bpe_tree, edit_match, lang_mixture, near_dup, toxic_crf
from vigil.llm.common import discard, staged, table, where

#: A document stays if its leading language has at least this share and certainty.
LEAST_LANGUAGE = 0.5
#: Documents are near copies from this similarity on, in hundredths (``op7_bayes_minhash`` has its own).
NEAR_COPY = 80

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field predicts as toxic go."""
    return toxic_crf.keep_clean(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or of uncertain language, go."""
    return lang_mixture.keep_certain(docs, LEAST_LANGUAGE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id."""
    return near_dup.keep_one(docs, hundredths=NEAR_COPY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return edit_match.keep_unleaked(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every document that is left."""
    return bpe_tree.encode_documents(docs, bpe_tree.default_path())


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        if last:  # nothing reads the stage before any more
            discard(spark, last)
        last = where(docs)
    return docs
