"""Text around hits. Cut to the best documents before: offsets need a window over a document's pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmith.functions.tokenize import QUERY_ONE

AROUND, TOP = 100, 5


def segments(hits: DataFrame, texts: DataFrame, around: int = AROUND) -> DataFrame:
    """doc_id, segment (from 0, in text order), start_pos, end_pos (inclusive), score and text.

    hits: doc_id, term, term_score. texts: doc_id, content. Words are cut at the query's delimiters and compare whole; a word's window
    reaches ``around`` characters to both sides, and windows that overlap or share a character merge and add their scores.
    """
    content = texts.select("doc_id", F.concat("content", F.lit("\n")).alias("content"))
    pieces = content.select("doc_id", F.length("content").alias("size"), F.posexplode(F.split("content", QUERY_ONE, -1)).alias("i", "piece"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("at", F.coalesce(F.sum(F.length("piece") + 1).over(before), F.lit(0)))
    found = placed.join(hits.select("doc_id", F.col("term").alias("piece"), "term_score"), ["doc_id", "piece"])
    spans = found.select("doc_id", "i", F.greatest(F.col("at") - around, F.lit(0)).alias("a"), F.least(F.col("at") + F.length("piece") + around, F.col("size") - 1).alias("b"), "term_score")
    order = Window.partitionBy("doc_id").orderBy("i")
    new = (~F.coalesce(F.lag("b").over(order) >= F.col("a"), F.lit(False))).cast("int")
    runs = spans.withColumn("new", new).withColumn("segment", F.sum("new").over(order) - 1)
    merged = runs.groupBy("doc_id", "segment").agg(F.min("a").cast("long").alias("start_pos"), F.max("b").cast("long").alias("end_pos"), F.round(F.sum("term_score"), 6).alias("score"))
    cut = F.expr("substring(content, cast(start_pos + 1 as int), cast(end_pos - start_pos + 1 as int))")
    return merged.join(content, "doc_id").select("doc_id", "segment", "start_pos", "end_pos", "score", cut.alias("text"))


def best_segments(found: DataFrame, k: int = TOP) -> DataFrame:
    """The k segments of each document with the highest score, the first of equals."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "start_pos")
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).drop("k")
