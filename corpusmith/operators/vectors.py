"""Sparse term vectors in long form: (key, term, weight)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmith.functions.shared import written
from corpusmith.functions.ship import map_arrow
from corpusmith.functions.tokenize import index_terms
from corpusmith.plans import index

TF_LIMIT = 10


def term_vectors(posts: DataFrame) -> DataFrame:
    return posts.select("doc_id", "term", F.col("tf").cast("double").alias("weight"))


def centroids(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """side, term and weight: sums over each side's documents by their number. members: doc_id, side; documents without a term count."""
    sizes = members.groupBy("side").agg(F.count("*").alias("n"))
    sums = vectors.join(members, "doc_id").groupBy("side", "term").agg(F.sum("weight").alias("w"))
    return sums.join(F.broadcast(sizes), "side").select("side", "term", (F.col("w") / F.col("n")).alias("weight"))


class _Sums:
    """Of rows with a side and terms: side, term and the side's occurrences of it, of some documents side by side."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in index.slices(b):
                names, term, row, tf, _ = index.distinct(part)
                sides = part.column("side").dictionary_encode()
                n = max(1, len(names))
                key, of = np.unique(sides.indices.to_numpy()[row].astype(np.int64) * n + term, return_inverse=True)
                side, term = np.divmod(key, n)
                yield pa.RecordBatch.from_arrays([sides.dictionary.take(pa.array(side)), names.take(pa.array(term)), pa.array(np.bincount(of, tf, len(key)))], ["side", "term", "w"])


def text_centroids(docs: DataFrame) -> DataFrame:
    """centroids() of documents (side, content; both without nulls): a pass over the texts, and what is shuffled is sums of slices of documents."""
    rows = docs.select("side", index_terms("content").alias("terms"))
    sums = map_arrow(rows, _Sums(), f"side {docs.schema['side'].dataType.simpleString()}, term string, w double").groupBy("side", "term").agg(F.sum("w").alias("w"))
    sizes = docs.groupBy("side").agg(F.count("*").alias("n"))
    return sums.join(F.broadcast(sizes), "side").select("side", "term", (F.col("w") / F.col("n")).alias("weight"))


def norms(vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    return vectors.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """a, b and cosine of each pair of documents; null if one has no term."""
    left, right = (vectors.select(F.col("doc_id").alias(k), "term", F.col("weight").alias(f"w{k}")) for k in "ab")
    dots = pairs.select("a", "b").join(left, "a").join(right, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    n = norms(vectors)
    both = pairs.select("a", "b").join(dots, ["a", "b"], "left")
    for k in "ab":
        both = both.join(n.select(F.col("doc_id").alias(k), F.col("norm").alias(f"n{k}")), k, "left")
    return both.select("a", "b", F.try_divide(F.coalesce("dot", F.lit(0.0)), F.col("na") * F.col("nb")).alias("cosine"))


class _InOrder:
    """Documents in order, with terms: doc_id, its cosine with the one before (before), and terms of the first and the last, which part's neighbours need."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, first = TaskContext.get().partitionId(), None, True
        for b in batches:
            for rows in index.slices(b):
                now = rows if before is None else pa.Table.from_batches([before, rows]).combine_chunks().to_batches()[0]
                yield from self.edge(now.slice(0, 1), part) if first else ()
                first, before = False, now.slice(now.num_rows - 1)
                yield from self.cosines(now, part)
        if before is not None:
            yield from self.edge(before, part)

    @staticmethod
    def cosines(rows: pa.RecordBatch, part: int) -> Iterator[pa.RecordBatch]:
        _, term, row, tf, _ = index.distinct(rows)
        n = rows.num_rows
        if n < 2:
            return
        # Entries are sorted by term and row, so a term that two documents in a row share stands side by side.
        both = np.flatnonzero((term[1:] == term[:-1]) & (row[1:] == row[:-1] + 1))
        dot, norm = np.bincount(row[both], tf[both] * tf[both + 1], n)[: n - 1], np.sqrt(np.bincount(row, tf * tf, n))
        size = norm[:-1] * norm[1:]
        cosine = pa.array(np.divide(dot, size, out=np.zeros(n - 1), where=size > 0), mask=size == 0)
        ids = rows.column("doc_id")
        yield pa.RecordBatch.from_arrays([ids.slice(0, n - 1), ids.slice(1), cosine, pa.array(np.full(n - 1, part)), pa.nulls(n - 1, pa.list_(pa.string()))], ["a", "b", "cosine", "part", "terms"])

    @staticmethod
    def edge(row: pa.RecordBatch, part: int) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([row.column("doc_id"), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([part]), row.column("terms").cast(pa.list_(pa.string()))], ["a", "b", "cosine", "part", "terms"])


def _over_seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the first and last documents of parts, in order: the cosines of those that lie in different parts."""
    before = None
    for b in batches:
        for k in range(b.num_rows):
            row = b.slice(k, 1)
            if before is not None and before.column("part")[0] != row.column("part")[0]:
                yield from (x.select(["a", "b", "cosine"]) for x in _InOrder.cosines(pa.Table.from_batches([before, row]).combine_chunks().to_batches()[0], 0))
            before = row


def next_cosines(corpus: DataFrame) -> DataFrame:
    """a, b and cosine of each document with the next by doc_id; null if one has no term. Texts are sorted over ranges, once; of a range's
    seams two documents pass one task in a stream. Written; drop_written of the result drops it."""
    texts = corpus.where("doc_id is not null").select("doc_id", "content").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows = map_arrow(texts.select("doc_id", index_terms("content").alias("terms")), _InOrder(), "a long, b long, cosine double, part long, terms array<string>")
    held = written(rows, "cosines")
    seams = held.where("terms is not null").select(F.col("a").alias("doc_id"), "part", "terms").repartition(1).sortWithinPartitions("doc_id", "part")
    out = held.where("b is not null").select("a", "b", "cosine").unionByName(map_arrow(seams, _over_seams, "a long, b long, cosine double"))
    out.shared_path = held.shared_path
    return out


def side_cosines(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """doc_id, side and cosine to each centroid that shares a term with the document."""
    dots = vectors.join(centers.withColumnRenamed("weight", "cw"), "term").groupBy("doc_id", "side").agg(F.sum(F.col("weight") * F.col("cw")).alias("dot"))
    side_norms = centers.groupBy("side").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("side_norm"))
    return dots.join(norms(vectors), "doc_id").join(F.broadcast(side_norms), "side").select("doc_id", "side", F.try_divide("dot", F.col("norm") * F.col("side_norm")).alias("cosine"))


def assigned(docs: DataFrame, vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """doc_id and side of every document: 1 if strictly closer to the first centroid, else 2."""
    by_side = side_cosines(vectors, centers).groupBy("doc_id").agg(*(F.coalesce(F.max(F.when(F.col("side") == s, F.col("cosine"))), F.lit(0.0)).alias(f"c{s}") for s in (1, 2)))
    both = docs.select("doc_id").join(by_side, "doc_id", "left")
    return both.select("doc_id", F.when(F.round(F.coalesce("c1", F.lit(0.0)), 9) > F.round(F.coalesce("c2", F.lit(0.0)), 9), 1).otherwise(2).alias("side"))


def graph(posts: DataFrame, limit: int = TF_LIMIT) -> DataFrame:
    """Edges a < b with cosine weight between documents that share a term of at most ``limit`` occurrences in both.

    One self-join on term gives the dot products over all terms and the edges at once. Its size is the sum of squared list
    lengths: meant for the sample or cluster that a split works on.
    """
    left, right = (posts.select(F.col("doc_id").alias(k), "term", F.col("tf").alias(f"t{k}")) for k in "ab")
    pairs = left.join(right, "term").where("a < b")
    dots = pairs.groupBy("a", "b").agg(F.sum((F.col("ta") * F.col("tb")).cast("double")).alias("dot"), F.max((F.col("ta") <= limit) & (F.col("tb") <= limit)).alias("edge"))
    n = norms(term_vectors(posts))
    return dots.where("edge").join(n.select(F.col("doc_id").alias("a"), F.col("norm").alias("na")), "a").join(n.select(F.col("doc_id").alias("b"), F.col("norm").alias("nb")), "b").select("a", "b", F.round(F.try_divide("dot", F.col("na") * F.col("nb")), 6).alias("weight"))


def order_decision(ml: DataFrame, mr: DataFrame, m1: DataFrame, m2: DataFrame) -> DataFrame:
    """keep: whether side 1 stays left. Each argument is (term, weight); a cosine with an empty vector is 0."""
    parts = [x.select(F.lit(n).alias("name"), "term", "weight") for n, x in (("l", ml), ("r", mr), ("1", m1), ("2", m2))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("term").pivot("name", ["l", "r", "1", "2"]).agg(F.sum("weight"))
    dot = lambda x, y: F.coalesce(F.sum(F.col(f"`{x}`") * F.col(f"`{y}`")), F.lit(0.0))
    cos = lambda x, y: F.coalesce(F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))), F.lit(0.0))
    return every.agg(F.round(cos("l", "1") * cos("r", "2"), 6).alias("straight"), F.round(cos("l", "2") * cos("r", "1"), 6).alias("crossed")).withColumn("keep", F.col("straight") > F.col("crossed"))
