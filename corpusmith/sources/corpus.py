"""Collections as (doc_id, url, content) and the document store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "doc_id long, url string, content string"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html", F.col("url"))


def from_table(table: DataFrame, key: str, text: str, url: Column | None = None) -> DataFrame:
    """Any table with a dense key and a text; a null text is an empty document."""
    made = F.concat(F.lit("doc://"), F.col(key).cast("string")) if url is None else url
    return table.select(F.col(key).cast("long").alias("doc_id"), made.alias("url"), F.coalesce(F.col(text), F.lit("")).alias("content"))


def trec(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Records of a TREC file, doc_id dense from 0 in file order; of several files one after the other, by path.

    Empty lines are skipped. A record is lines that begin with <DOC>, <DOCNO> and <TEXT>, then the url, lines of content (each with its
    line feed; a carriage return is part of the line), </TEXT> and </DOC>. A file may end within a record. The first record without a
    url ends the input: what follows isn't looked at. A line that is none of what must come is an error when strict; else its record is
    left out and keeps its number, and a bad line after </TEXT> counts for the record that follows.
    """
    # The text of a record ends at the first line that begins with </TEXT>, so pieces between these hold the end of one record and the begin of the next.
    raw = spark.read.option("lineSep", "\n</TEXT>").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    pieces = raw.withColumn("pid", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    group = ["file_path", "file_block_start", "pid"]
    filled = lambda x: x != ""
    # The first piece of a file begins with its first line, any other with the rest of a </TEXT> line.
    alone = F.size(F.filter(F.split("value", "\n"), filled)) == 0
    closing = F.size(F.filter(F.slice(F.split("value", "\n"), 2, 1 << 30), filled)) <= 1
    counts = pieces.groupBy(*group).agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high"), F.max_by(F.struct(alone.alias("alone"), closing.alias("closing")), "at").alias("tail"))
    # As many rows as blocks of files are read. The last piece of a file may hold no record.
    last = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("file_block_start"))) == 1
    counts = counts.withColumn("last", last).withColumn("opens", F.col("file_block_start") == 0)
    empty = F.col("last") & F.when(F.col("opens") & (F.col("n") == 1), F.col("tail.alone")).otherwise(F.col("tail.closing"))
    order = Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum(F.col("n") - empty.cast("int")).over(order), F.lit(0))).drop("tail", "n")
    first = F.col("opens") & (F.col("at") == F.col("low"))
    lines = F.filter(F.slice(F.split("value", "\n"), F.when(first, 1).otherwise(2), F.lit(1 << 30)), filled)
    rows = pieces.join(counts, group).select((F.col("before") + F.col("at") - F.col("low")).alias("doc_id"), first.alias("first"), (F.col("last") & (F.col("at") == F.col("high"))).alias("ends"), lines.alias("lines"))
    closed = F.col("first") | (F.size("lines") == 0) & F.col("ends") | F.coalesce(F.get("lines", F.lit(0)).startswith("</DOC>"), F.lit(False))
    own = F.when(F.col("first"), F.col("lines")).otherwise(F.slice("lines", 2, 1 << 30))
    rows = rows.select("doc_id", "ends", closed.alias("closed"), own.alias("l"), F.get("lines", F.lit(0)).alias("line")).where(~F.col("ends") | (F.size("l") > 0) | ~F.col("closed"))
    opened = F.lit(True)
    for k, tag in enumerate(("<DOC>", "<DOCNO>", "<TEXT>")):
        opened = opened & F.coalesce(F.get("l", F.lit(k)).startswith(tag), F.col("ends"))
    url = F.get("l", F.lit(3))
    content = F.when(F.size("l") > 4, F.concat(F.array_join(F.slice("l", 5, 1 << 30), "\n"), F.lit("\n"))).otherwise("")
    found = rows.select("doc_id", (F.col("closed") & opened).alias("good"), F.coalesce(F.get("l", F.lit(0)), "line").alias("head"), url.alias("url"), content.alias("content"))
    stop = found.where("good and url is null").agg(F.min("doc_id")).first()[0]
    if stop is not None:
        found = found.where(F.col("doc_id") < stop)
    if strict:
        fail = F.raise_error(F.concat(F.lit("malformed TREC record: "), F.coalesce("head", F.lit(""))))
        return found.select("doc_id", F.when(F.col("good"), F.col("url")).otherwise(fail).alias("url"), "content").where("url is not null")
    return found.where("good").select("doc_id", "url", "content").where("url is not null")


class Store:
    """The document store: a Parquet table of (doc_id, url, doc_length, content)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, docs: DataFrame) -> None:
        """Sorted by doc_id, so that a point or range is a few row groups."""
        docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("append").option("maxRecordsPerFile", 1_000_000).parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def get(self, *doc_ids: int) -> DataFrame:
        return point(self.table(), *doc_ids)

    def between(self, low: int, high: int) -> DataFrame:
        return key_range(self.table(), low, high)

    def count(self) -> int:
        return self.table().count()


def first_part(docs: DataFrame, fraction: float = 1.0) -> DataFrame:
    """The documents of the least ids, so many of all; for trials of what is costly, as reordering is."""
    if not 0 <= fraction <= 1:
        raise ValueError("a fraction lies between 0 and 1")
    return docs if fraction == 1 else docs.where(F.col("doc_id") < int(docs.count() * fraction))


def point(docs: DataFrame, *doc_ids: int) -> DataFrame:
    """Documents of these ids; none for an unknown one."""
    return docs.where(F.col("doc_id").isin(*doc_ids)) if doc_ids else docs.where("false")


def key_range(docs: DataFrame, low: int, high: int) -> DataFrame:
    """low <= doc_id < high."""
    return docs.where((F.col("doc_id") >= low) & (F.col("doc_id") < high))
