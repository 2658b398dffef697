"""The training-data pipeline: five stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import decontaminate, jaccard, pieces, quality, substrings
from storyloom.llm.common import discard, saved, scratch, table

#: None: the scores of the trained network cannot be put in SQL; tests/llm/test_queries.py holds every stage against its operator.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier scores at its threshold or above."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least doc_id of each group linked by 5-word shingles at a similarity of 0.8 or more."""
    return jaccard.one_of_each_group(docs, 5, 80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the words that 20-word windows repeat from an earlier place; every document stays."""
    return substrings.without_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item within an edit distance of a fifth of its words."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the best segmentation, its score and those of the N best, for every document."""
    return pieces.encode_texts(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, with a table in the shared folder between one and the next. What a stage saved
    on its way goes when its table is written, and a stage's table when the next one's is; the last is returned."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            written = saved(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        docs = before = written
    return STAGES[-1][1](spark, docs, sf_dir)
