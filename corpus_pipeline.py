"""A corpus pipeline: quality rules, quality classifier, near-dedup, substring dedup, packing.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``; what a stage rejects or cuts is gone for those after it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loamgrid.llm import packing, passages, quality_classifier, quality_rules, simhash
from loamgrid.llm.common import read, settle
from loamgrid.session import ship


def stage_quality_rules(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust outlier test reject go."""
    ship(spark)
    return quality_rules.keep_good(read(spark, sf_dir, "documents") if docs is None else docs)


def stage_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold go; the fit is on all labelled documents of the table."""
    return quality_classifier.keep_good(docs, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id."""
    ship(spark)
    return simhash.keep_one(docs)


def stage_substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that nearly repeat one of a document of smaller id are cut out."""
    ship(spark)
    return passages.cut_repeats(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is tokenised and packed into sequences, one row per piece."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", stage_quality_rules),
    ("quality_classifier", stage_quality_classifier),
    ("simhash_near_dedup", stage_near_dedup),
    ("substring_dedup", stage_substring_dedup),
    ("best_fit_packing", stage_packing),
]

#: The stages fit models and hash with XXH64, which SQL can't express; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table; each result is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
