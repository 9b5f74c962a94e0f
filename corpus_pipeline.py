"""The corpus pipeline: quality, exact and near duplicates, personal data, packing.

Every stage works on all rows that the one before kept. All but the last return the
columns of ``documents``; the last returns pieces of packed token sequences.

Defined results: an empty table passes through all stages; null texts count as
empty in every stage; other columns are kept until the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docloom.deploy import ship
from docloom.llm import exact_dedup, near_dedup, packing, pii, quality
from docloom.llm.common import drop, read, stage, temporary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, doesn't reject."""
    ship(spark)
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of equal texts."""
    ship(spark)
    return exact_dedup.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of each class of near duplicates: five-word shingles, Jaccard similarity of 0.8 or more, by pigeonring over sketches and exact checks."""
    ship(spark)
    return near_dedup.keep_one_of_each_class(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    ship(spark)
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("near-dedup", without_near_copies),
    ("PII", without_personal_data),
    ("packing", packed),
]
ORACLE_SQL = None  # the classifier and the tokenizer have no SQL; tests hold the stages against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        with temporary() as stay:
            out = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
            stay.append(out)
        drop(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
