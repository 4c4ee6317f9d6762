"""The inverted index: tables, each a plain DataFrame.

docs      doc_id, url, doc_length
postings  term, doc_id, tf, doc_length   sorted by (term, doc_id) over ranges, so a term's rows are few row groups;
                                         the length is held here too, so that a score needs no join with all documents
lists     the postings with k, the place in the list from 1, and prev, the doc_id before (null at first)
lexicon   term, df, cf                sorted by term
stats     n_docs, n_tokens, avgdl     one row

A saved index holds each range's own numbers beside its postings, and in spans, one row a range, what came before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.functions.shared import drop_written, new_path, written
from corpusmith.functions.ship import map_arrow
from corpusmith.functions.tokenize import index_terms

from . import ranges

#: Postings in a chunk, the unit of skipping.
CHUNK = 128
#: Tokens that are counted side by side, postings of a piece of a list, and postings that leave Python together.
SLICE, PIECE, FLAT = 1 << 20, 64, 1 << 17
#: Low bits of a doc_id that a piece holds for each posting; the rest is its bucket.
BUCKET = 16
LOW = (1 << BUCKET) - 1
POSTING = np.dtype([("low", "<u2"), ("tf", "<u4"), ("length", "<u4")])
_POSTINGS = "term string, doc_id long, tf long, doc_length long"


@dataclass(frozen=True)
class Index:
    docs: DataFrame
    postings: DataFrame
    lexicon: DataFrame
    stats: DataFrame
    saved_lists: DataFrame | None = None

    @property
    def lists(self) -> DataFrame:
        return numbered(self.postings) if self.saved_lists is None else self.saved_lists


def tokens(corpus: DataFrame) -> DataFrame:
    """(doc_id, term) for each token."""
    return corpus.select("doc_id", F.explode(index_terms("content")).alias("term"))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Documents of some SLICE tokens together, so that what is counted side by side has a bound."""
    ends = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def distinct(part: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents with their terms: the terms, and of each document's distinct ones, by term and row, number of the term, row, tf and length."""
    lists = part.column("terms")
    names = lists.flatten().dictionary_encode()
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = max(1, len(n))
    key, tf = np.unique(names.indices.to_numpy().astype(np.int64) * rows + np.repeat(np.arange(len(n)), n), return_counts=True)
    term, row = np.divmod(key, rows)
    return names.dictionary, term, row, tf, n[row]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents with their terms: one row a document and distinct term."""
    for b in batches:
        for part in slices(b):
            names, term, row, tf, length = distinct(part)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(term)), part.column("doc_id").take(pa.array(row)), pa.array(tf), pa.array(length)], ["term", "doc_id", "tf", "doc_length"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents with their terms: pieces of lists, PIECE postings of a term and bucket of ids at most, and a row of documents a slice."""
    schema = pa.schema([("term", pa.string()), ("bucket", pa.int64()), ("df", pa.int64()), ("cf", pa.int64()), ("data", pa.binary()), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("url", pa.string()), ("doc_length", pa.int64())])))])
    for b in batches:
        ids = b.column("doc_id").to_numpy()
        for part in slices(b if (ids[1:] >= ids[:-1]).all() else b.sort_by("doc_id")):
            names, term, row, tf, length = distinct(part)
            ids = part.column("doc_id").to_numpy()
            if len(term):
                doc = ids[row]
                new = np.r_[True, (term[1:] != term[:-1]) | (doc[1:] >> BUCKET != doc[:-1] >> BUCKET)]
                at = np.arange(len(term))
                new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % PIECE == 0
                start = np.flatnonzero(new)
                held = np.empty(len(term), POSTING)
                held["low"], held["tf"], held["length"] = doc & LOW, tf, length
                df = np.diff(np.r_[start, len(term)])
                data = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((np.r_[0, np.cumsum(df)] * POSTING.itemsize).astype(np.int32).tobytes()), pa.py_buffer(held.tobytes())])
                none = pa.nulls(len(start), schema.field("docs").type)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(term[start])), pa.array(doc[start] >> BUCKET), pa.array(df), pa.array(np.add.reduceat(tf, start).astype(np.int64)), data, none], schema=schema)
            lengths = part.column("terms").value_lengths().cast(pa.int64())
            docs = pa.StructArray.from_arrays([part.column("doc_id"), part.column("url"), lengths], fields=list(schema.field("docs").type.value_type))
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in schema)][:-1] + [pa.ListArray.from_arrays([0, len(docs)], docs, type=schema.field("docs").type)], schema=schema)


class _Flat:
    """Pieces sorted by term and bucket as postings in order. No more is held than a batch and the pieces of one term and bucket."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return ranges.Number("doc_id")(self.flat(batches))

    def flat(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            new = self.begins(b)
            # The last term and bucket of a batch may go on in the next one.
            last = int(new[-1]) if len(new) else 0
            if held and b.num_rows and not last and self.same(held[-1], b):
                held.append(b)
                continue
            if not b.num_rows:
                continue
            yield from self.postings([*held, b.slice(0, last)])
            held = [b.slice(last)]
        yield from self.postings(held)

    @staticmethod
    def begins(b: pa.RecordBatch) -> np.ndarray:
        """Where a term and bucket begins that isn't that of the row before."""
        n = b.num_rows
        if n < 2:
            return np.zeros(0, np.int64)
        term, bucket = b.column("term"), b.column("bucket").to_numpy()
        return 1 + np.flatnonzero(pc.not_equal(term.slice(1), term.slice(0, n - 1)).to_numpy(zero_copy_only=False) | (bucket[1:] != bucket[:-1]))

    @staticmethod
    def same(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
        return all(a.column(c)[a.num_rows - 1] == b.column(c)[0] for c in ("term", "bucket"))

    def postings(self, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks() if held else None
        if rows is None or not rows.num_rows:
            return
        b = rows.to_batches()[0]
        n, of = b.column("df").to_numpy(), np.zeros(b.num_rows, np.int64)
        of[self.begins(b)] = 1
        flat = np.frombuffer(b"".join(b.column("data").to_pylist()), POSTING)
        row = np.repeat(np.arange(b.num_rows), n)
        key = np.cumsum(of)[row] << BUCKET | flat["low"]
        if len(key) > 1 and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            flat, row = flat[order], row[order]
        ids = b.column("bucket").to_numpy()[row] << BUCKET | flat["low"]
        for lo in range(0, len(row), FLAT):
            cut = slice(lo, lo + FLAT)
            yield pa.RecordBatch.from_arrays([b.column("term").take(pa.array(row[cut])), pa.array(ids[cut]), pa.array(flat["tf"][cut].astype(np.int64)), pa.array(flat["length"][cut].astype(np.int64))], ["term", "doc_id", "tf", "doc_length"])


def postings(corpus: DataFrame) -> DataFrame:
    """term, doc_id, tf, doc_length of documents of distinct doc_id. A document is counted in its row, so nothing is shuffled here."""
    return map_arrow(corpus.select("doc_id", index_terms("content").alias("terms")), _counted, _POSTINGS)


def numbered(posts: DataFrame) -> DataFrame:
    """Postings with k and prev; those that have them are as they are."""
    return posts if {"k", "prev"} <= {*posts.columns} else ranges.numbered(posts, "doc_id")


def doc_table(corpus: DataFrame) -> DataFrame:
    """doc_id, url and number of tokens of every document, also of those without a token. A narrow pass."""
    return corpus.select("doc_id", "url", F.size(index_terms("content")).cast("long").alias("doc_length"))


def lexicon(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def stats(docs: DataFrame) -> DataFrame:
    """n_docs and average length count documents without a token too."""
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("doc_length"), F.lit(0)).alias("n_tokens"), F.avg("doc_length").alias("avgdl"))


def build(corpus: DataFrame) -> Index:
    """The index as lazy tables."""
    posts, docs = postings(corpus), doc_table(corpus)
    return Index(docs, posts, lexicon(posts), stats(docs))


def save(corpus: DataFrame, path: str) -> Index:
    """Builds and writes the index: one pass over the texts writes pieces of lists, and what is sorted is these.

    Ranges of (term, bucket of ids) split a frequent term over several files, so no partition holds all of it.
    """
    spark, kind = corpus.sparkSession, "term string, bucket long, df long, cf long, data binary, docs array<struct<doc_id: long, url: string, doc_length: long>>"
    pieces = written(map_arrow(corpus.select("doc_id", "url", index_terms("content").alias("terms")), _pieces, kind), "pieces")
    lists, by = pieces.where("term is not null"), ["term", "bucket"]
    rows = lists.select(*by, "df", "data").repartitionByRange(*by).sortWithinPartitions(*by)
    map_arrow(rows, _Flat(), ranges.schema_of(spark.createDataFrame([], _POSTINGS))).write.parquet(f"{path}/postings")
    pieces.where("docs is not null").select(F.inline("docs")).write.parquet(f"{path}/docs")
    words = lists.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    return _saved(spark, words, path, pieces)


def save_postings(posts: DataFrame, docs: DataFrame, path: str) -> Index:
    spark = posts.sparkSession
    ranges.ranged(posts, "doc_id").write.parquet(f"{path}/postings")
    docs.write.parquet(f"{path}/docs")
    return _saved(spark, lexicon(spark.read.parquet(f"{path}/postings")), path)


def _saved(spark: SparkSession, words: DataFrame, path: str, *made: DataFrame) -> Index:
    """The rest of an index whose postings and docs are written; then drops what it was made of."""
    ranges.spans(spark.read.parquet(f"{path}/postings"), "doc_id").coalesce(1).write.parquet(f"{path}/spans")
    words.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/lexicon")
    stats(spark.read.parquet(f"{path}/docs")).write.parquet(f"{path}/stats")
    drop_written(*made)
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    docs, held, words, one, span = (spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "lexicon", "stats", "spans"))
    return Index(docs, held.select("term", "doc_id", "tf", "doc_length"), words, one, ranges.placed(held, span))


_BUILT: dict[tuple[str, str], str] = {}


def shared(spark: SparkSession, corpus: DataFrame, name: str) -> Index:
    """The saved index of a named corpus, built once for an application."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _BUILT:
        path = new_path(spark, "index")
        save(corpus, path)
        _BUILT[key] = path
    return load(spark, _BUILT[key])


class _Runs:
    """Rows (term, chunk_no, k and values) that follow each other in k as one row with a list."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            term, chunk, k = b.column("term"), b.column("chunk_no").to_numpy(), b.column("k").to_numpy()
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(term.slice(1), term.slice(0, n - 1)).to_numpy(zero_copy_only=False) | (chunk[1:] != chunk[:-1]) | (k[1:] != k[:-1] + 1)
            start = np.flatnonzero(new)
            values = pa.StructArray.from_arrays(b.columns[3:], b.schema.names[3:])
            yield pa.RecordBatch.from_arrays([term.take(pa.array(start)), pa.array(chunk[start]), pa.array(k[start]), pa.ListArray.from_arrays(pa.array(np.r_[start, n].astype(np.int32)), values)], ["term", "chunk_no", "k", "list"])


def gathered(rows: DataFrame, *values: str) -> DataFrame:
    """term, chunk_no and the list of values, by k, of rows of term, chunk_no, k and values (long). What is shuffled is runs of rows, as a sorted table has them."""
    kind = "array<struct<" + ", ".join(f"{v}: long" for v in values) + ">>"
    runs = map_arrow(rows.select("term", "chunk_no", "k", *values), _Runs(), f"term string, chunk_no long, k long, list {kind}")
    parts = F.sort_array(F.collect_list(F.struct("k", "list")))
    return runs.groupBy("term", "chunk_no").agg(F.flatten(F.transform(parts, lambda x: x["list"])).alias("list"))


def packed(posts: DataFrame, size: int = CHUNK) -> DataFrame:
    """term, chunk_no and the chunk's list: ascending (doc_id, tf), size of them at most. A list is as many rows as it has chunks."""
    return gathered(in_chunks(posts, size), "doc_id", "tf")


def in_chunks(posts: DataFrame, size: int = CHUNK) -> DataFrame:
    """Postings with k, prev and chunk_no."""
    return numbered(posts).withColumn("chunk_no", F.floor((F.col("k") - 1) / size).cast("long"))


def partial_postings(corpus: DataFrame, run: Column) -> DataFrame:
    """Postings of each run of documents on its own: run, term, doc_id, tf. Each of the corpus's rows is counted in its row."""
    rows = corpus.select(run.cast("long").alias("run"), "doc_id", index_terms("content").alias("terms"))
    return map_arrow(rows, _counted_of_runs, "run long, term string, doc_id long, tf long")


def _counted_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in slices(b):
            names, term, row, tf, _ = distinct(part)
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column("run").take(rows), names.take(pa.array(term)), part.column("doc_id").take(rows), pa.array(tf)], ["run", "term", "doc_id", "tf"])


def merged(parts: DataFrame) -> DataFrame:
    """One list a term from the runs' lists; a document in two runs has its counts added."""
    return parts.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))


def term_bytes(corpus: DataFrame) -> DataFrame:
    """doc_id and what its tokens take in a run's buffer: their bytes and four for each."""
    terms = index_terms("content")
    return corpus.select("doc_id", (F.octet_length(F.array_join(terms, "")) + 4 * F.size(terms)).cast("long").alias("bytes"))


class _Fold:
    def __init__(self, budget: int):
        self.budget = budget

    def __call__(self, batches):
        import pyarrow as pa

        run = held = 0
        for b in batches:
            out = []
            for size in b.column("bytes").to_pylist():
                out.append(run)
                held += size
                if held >= self.budget:
                    run, held = run + 1, 0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("bytes"), pa.array(out, pa.int64())], ["doc_id", "bytes", "run"])


def assigned_runs(sizes: DataFrame, budget: int) -> DataFrame:
    """doc_id, bytes and run: a greedy fold in doc_id order that ends a run with the document that reaches the budget.

    Where a run begins depends on all before it, so (doc_id, bytes), and nothing more, passes one task in a sorted stream that holds one batch.
    """
    return map_arrow(sizes.select("doc_id", "bytes").repartition(1).sortWithinPartitions("doc_id"), _Fold(budget), "doc_id long, bytes long, run long")


def chunks(posts: DataFrame, size: int = CHUNK) -> DataFrame:
    """term, chunk_no, first_doc_id, last_doc_id, n of each chunk of a list."""
    return in_chunks(posts, size).groupBy("term", "chunk_no").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"), F.count("*").alias("n"))


def rekeyed(index: Index, order: DataFrame) -> Index:
    """The index with documents renumbered by order(old_id, new_id): postings and doc table alike."""
    to = order.select(F.col("old_id").alias("doc_id"), "new_id")
    renumber = lambda t: t.join(to, "doc_id").drop("doc_id").withColumnRenamed("new_id", "doc_id")
    posts, docs = renumber(index.postings).select("term", "doc_id", "tf", "doc_length"), renumber(index.docs).select("doc_id", "url", "doc_length")
    return Index(docs, posts, index.lexicon, index.stats)
