"""A corpus from documents to tokens: five stages, each over all that the one before kept.

quality rules, near-duplicates, repeated passages, benchmark decontamination,
byte-level BPE. A stage takes (spark, docs, sf_dir); all but the last return
the columns of their docs. run() writes each stage's rows and reads them again.

Null, empty and repeated rows, ties and clashing names have the results that
the operators' docstrings define: an empty or null text fails the quality
rules; of repeated rows one stays; a text cut to nothing goes; very long texts pass
every stage whole. Tables that a stage leaves for its result are dropped once that
is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmith.functions.shared import drop_written, written
from corpusmith.llm import bpe, decontaminate, quality_rules, simhash, suffix_array

#: SimHash groups and BPE tokens have no SQL; tests/llm/test_pipeline.py runs the stages against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep(docs, [*quality_rules.INSULTS, *quality_rules.toxic_terms(docs, labels)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_array.cut(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", decontamination),
    ("byte_level_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        after = written(made, name)
        drop_written(made)
        if before is not None:
            drop_written(before)
        docs = before = after
    return docs
