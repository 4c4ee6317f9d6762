"""Text forms of the doc table and the lexicon: fields of a row separated by one space, a line a row.

A term may hold a tab or a carriage return, so lines end at a line feed only and numbers are what follows the last spaces. A line
feed in a url is written as a space, as it would end the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_doc_table(docs: DataFrame, path: str) -> None:
    docs.select(F.concat_ws(" ", F.col("doc_id").cast("string"), F.regexp_replace(F.coalesce("url", F.lit("")), "\n", " "), F.col("doc_length").cast("string")).alias("value")).write.text(path)


def read_doc_table(spark: SparkSession, path: str) -> DataFrame:
    field = lambda k: F.regexp_extract("value", r"(?s)^(\d+) (.*) (\d+)$", k)
    rows = spark.read.option("lineSep", "\n").text(path).where("value <> ''")
    return rows.select(field(1).cast("long").alias("doc_id"), field(2).alias("url"), field(3).cast("long").alias("doc_length"))


_CURSORS = ["block_cursor", "chunk_offset", "df"]


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """term and df, with the block cursor and chunk offset between them where the lexicon has them."""
    numbers = [c for c in _CURSORS if c in lexicon.columns]
    lexicon.select(F.concat_ws(" ", "term", *(F.col(c).cast("string") for c in numbers)).alias("value")).write.text(path)


def read_lexicon(spark: SparkSession, path: str, cursors: bool = False) -> DataFrame:
    numbers = _CURSORS if cursors else ["df"]
    field = lambda k: F.regexp_extract("value", r"(?s)^(.*)" + r" (\d+)" * len(numbers) + "$", k)
    rows = spark.read.option("lineSep", "\n").text(path).where("value <> ''")
    return rows.select(field(1).alias("term"), *(field(k + 2).cast("long").alias(c) for k, c in enumerate(numbers)))
