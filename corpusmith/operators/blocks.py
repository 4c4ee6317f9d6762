"""Inverted lists as bytes: tables of encoded chunks, blocks of chunks with a header, and runs.

A chunk is the unit of coding and of skipping: up to CHUNK postings of one list.
``encode`` gives one row a chunk, with the codec that is named (CHUNK_CODECS is
where another is plugged in), and reading one takes its row only. ``blocks`` puts
chunks together to about so many bytes, in the order of (term, chunk_no), each
block with a header that tells where its chunks end and their last ids; the
lexicon's cursors are a block's place and a chunk's number in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmith.functions.shared import checked_broadcast, drop_written, written
from corpusmith.functions.ship import map_arrow
from corpusmith.plans.index import CHUNK, FLAT, packed

from . import codecs as C

BLOCK_BYTES = 1 << 20
#: Lists of a run that are encoded together.
RUN_PARTS = 16


def _binary(ids: np.ndarray, freqs: np.ndarray, at: np.ndarray) -> list[bytes]:
    """encode_chunk() of many chunks side by side."""
    # Gaps of a chunk are one fewer than its ids.
    inner = np.ones(len(ids), bool)
    inner[at[:-1]] = False
    gaps = np.diff(ids, prepend=0)[inner]
    words, word_at = C.simple9_words(gaps, at - np.arange(len(at)))
    data, width = words.tobytes(), np.maximum.reduceat(freqs, at[:-1]) if len(at) > 1 else freqs
    out = []
    for i, (lo, hi, w0, w1) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), word_at[:-1].tolist(), word_at[1:].tolist())):
        size = next(w for w in (1, 2, 4, 8) if int(width[i]) < 1 << 8 * w)
        head = C.varbyte(int(ids[lo])) + C.varbyte(hi - lo - 1)
        out.append(head + data[4 * w0 : 4 * w1] + bytes([size]) + (hi - lo).to_bytes(8, "little") + freqs[lo:hi].astype(f"<u{size}").tobytes())
    return out


def _plain(ids: np.ndarray, freqs: np.ndarray, at: np.ndarray) -> list[bytes]:
    return [C.plain_chunk(ids[lo:hi].tolist(), freqs[lo:hi].tolist()) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]


ChunkCodec = tuple[Callable[[np.ndarray, np.ndarray, np.ndarray], list[bytes]], Callable[[bytes], tuple[list[int], list[int]]]]
#: name: (encode many chunks, decode one).
CHUNK_CODECS: dict[str, ChunkCodec] = {"binary": (_binary, C.decode_chunk), "plain": (_plain, C.read_plain_chunk)}
#: Where a codec can decode many chunks side by side.
DECODE_MANY = {"binary": C.decode_chunks}


def _decoded(codec: str, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids and frequencies of chunks, and where each chunk's begin, and the end."""
    if codec in DECODE_MANY:
        return DECODE_MANY[codec](b"".join(data), np.cumsum([len(x) for x in data], dtype=np.int64))
    read = [CHUNK_CODECS[codec][1](x) for x in data]
    ids, freqs = (np.array([x for r in read for x in r[k]], np.int64) for k in (0, 1))
    return ids, freqs, np.r_[0, np.cumsum([len(i) for i, _ in read], dtype=np.int64)]


class _Encode:
    def __init__(self, codec: str):
        self.codec = codec

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = CHUNK_CODECS[self.codec][0]
        for b in batches:
            if not b.num_rows:
                continue
            rows = b.column("list")
            flat = rows.flatten()
            ids, freqs = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tf"))
            at = np.r_[0, np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            columns = [b.column("term"), b.column("chunk_no"), pa.array(ids[at[:-1]]), pa.array(ids[at[1:] - 1]), pa.array(np.diff(at)), pa.array(encode(ids, freqs, at), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["term", "chunk_no", "first_doc_id", "last_doc_id", "n", "data"])


def encode(posts: DataFrame, size: int = CHUNK, codec: str = "binary") -> DataFrame:
    """term, chunk_no, first_doc_id, last_doc_id, n and data of each chunk of each list."""
    if codec not in CHUNK_CODECS:
        raise ValueError(f"no codec {codec}; there are {', '.join(CHUNK_CODECS)}")
    return map_arrow(packed(posts, size), _Encode(codec), "term string, chunk_no long, first_doc_id long, last_doc_id long, n long, data binary")


class _Decode:
    def __init__(self, codec: str):
        self.codec = codec

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, freqs, at = _decoded(self.codec, b.column("data").to_pylist())
            owner = np.repeat(np.arange(b.num_rows), np.diff(at))
            for lo in range(0, len(owner), FLAT):
                few = slice(lo, lo + FLAT)
                own = pa.array(owner[few])
                yield pa.RecordBatch.from_arrays([b.column("term").take(own), b.column("chunk_no").take(own), pa.array(ids[few]), pa.array(freqs[few])], ["term", "chunk_no", "doc_id", "tf"])


class _DecodeLists:
    """Chunks' other columns with their postings as a list."""

    def __init__(self, codec: str):
        self.codec = codec

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, freqs, at = _decoded(self.codec, b.column("data").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays([pa.array(ids), pa.array(freqs)], ["doc_id", "tf"]))
            yield pa.RecordBatch.from_arrays([lists if c == "data" else b.column(c) for c in b.schema.names], ["list" if c == "data" else c for c in b.schema.names])


def decode_lists(chunks: DataFrame, codec: str = "binary") -> DataFrame:
    """The table of encoded chunks with list, ascending (doc_id, tf), in place of data. A chunk is decoded in its row."""
    kind = ", ".join("list array<struct<doc_id: long, tf: long>>" if c == "data" else f"`{c}` {t}" for c, t in chunks.dtypes)
    return map_arrow(chunks, _DecodeLists(codec), kind)


def decode(chunks: DataFrame, codec: str = "binary") -> DataFrame:
    """term, chunk_no, doc_id and tf of encoded chunks."""
    return map_arrow(chunks.select("term", "chunk_no", "data"), _Decode(codec), "term string, chunk_no long, doc_id long, tf long")


def load_chunk(chunks: DataFrame, term: str, chunk_no: int, codec: str = "binary") -> DataFrame:
    """The postings of one chunk: both filters reach the scan, so no other chunk is read. An unknown one has none."""
    return decode(chunks.where((F.col("term") == term) & (F.col("chunk_no") == chunk_no)), codec)


def next_geq(chunks: DataFrame, probes: list[tuple[str, int]], codec: str = "binary") -> DataFrame:
    """term, k and the least doc_id >= k in the term's list, null if there is none: the chunk table tells the one chunk to decode for each."""
    asked = F.broadcast(chunks.sparkSession.createDataFrame(probes, "term string, k long").distinct())
    table = chunks.where(F.col("term").isin(*{t for t, _ in probes}))
    which = table.select("term", "chunk_no", "last_doc_id").join(asked, "term").where("last_doc_id >= k").groupBy("term", "k").agg(F.min("chunk_no").alias("chunk_no"))
    # As many rows as probes.
    near = F.broadcast(which)
    found = decode(table.join(near.select("term", "chunk_no").distinct(), ["term", "chunk_no"], "left_semi"), codec)
    least = found.join(near, ["term", "chunk_no"]).where("doc_id >= k").groupBy("term", "k").agg(F.min("doc_id").alias("doc_id"))
    return asked.join(least, ["term", "k"], "left")


class _Block:
    """Chunks of a range in order, put together to blocks."""

    def __init__(self, limit: int):
        self.limit = limit

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        body, terms, n, last, size = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            header = C.encode_header(np.cumsum([len(x) for x in body]).tolist(), last, size, n[-1])  # noqa: B023
            entries = [{"term": t, "chunk_offset": k, "n": m} for k, (t, m) in enumerate(zip(terms, n))]  # noqa: B023
            kind = pa.list_(pa.struct([("term", pa.string()), ("chunk_offset", pa.int64()), ("n", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([header]), pa.array([b"".join(body)]), pa.array([entries], kind)], ["part", "seq", "header", "body", "entries"])  # noqa: B023

        for b in batches:
            for t, x, m, d in zip(*(b.column(c).to_pylist() for c in ("term", "data", "n", "last_doc_id"))):
                body.append(x)
                terms.append(t)
                n.append(m)
                last.append(d)
                size += len(x)
                if size >= self.limit:
                    yield out()
                    seq += 1
                    body, terms, n, last, size = [], [], [], [], 0
        if body:
            yield out()


def blocks(chunks: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """cursor, header, body and entries (term, chunk_offset, n) of each block: its bytes are four for the header's size, header and body,
    and its cursor is what the blocks before it take. Written; a block is no longer than limit and a chunk."""
    by = ["term", "chunk_no"]
    made = map_arrow(chunks.repartitionByRange(*by).sortWithinPartitions(*by), _Block(limit), "part long, seq long, header binary, body binary, entries array<struct<term string, chunk_offset long, n long>>")
    held = written(made, "blocks")
    # One row a block, without its bytes.
    before = F.coalesce(F.sum(4 + F.length("header") + F.length("body")).over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cursors = written(held.select("part", "seq", before.cast("long").alias("cursor")), "cursors")
    out = written(held.join(checked_broadcast(cursors, 24), ["part", "seq"]).select("cursor", "header", "body", "entries"), "blocks")
    drop_written(held, cursors)
    return out


def lexicon(table: DataFrame) -> DataFrame:
    """term, block_cursor, chunk_offset (of the list's first chunk) and df."""
    rows = table.select("cursor", F.explode("entries").alias("e"))
    return rows.groupBy("e.term").agg(F.min(F.struct("cursor", "e.chunk_offset")).alias("at"), F.sum("e.n").alias("df")).select("term", F.col("at.cursor").alias("block_cursor"), F.col("at.chunk_offset").alias("chunk_offset"), "df")


def chunk_data(header: bytes, body: bytes) -> list[bytes]:
    """A block's chunks, found by its header."""
    ends = C.decode_header(header)[0]
    return [body[lo:hi] for lo, hi in zip([0, *ends], ends)]


class _Open:
    def __init__(self, codec: str):
        self.codec = codec

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for header, body, asked in zip(*(b.column(c).to_pylist() for c in ("header", "body", "asked"))):
                chunks = chunk_data(header, body)
                ids, freqs, at = _decoded(self.codec, [chunks[x["chunk_offset"]] for x in asked])
                yield pa.RecordBatch.from_arrays([pa.array([x["term"] for x in asked]), pa.array(ids[at[:-1]]), pa.array(freqs[at[:-1]])], ["term", "first_doc_id", "first_tf"])


def opened(table: DataFrame, words: DataFrame, codec: str = "binary") -> DataFrame:
    """term, first_doc_id and first_tf of the lexicon's lists, read through their cursors. A block comes once for all lists that begin in it."""
    asked = words.groupBy(F.col("block_cursor").alias("cursor")).agg(F.collect_list(F.struct("term", "chunk_offset")).alias("asked"))
    rows = asked.join(table.select("cursor", "header", "body"), "cursor")
    return map_arrow(rows.select("header", "body", "asked"), _Open(codec), "term string, first_doc_id long, first_tf long")


def read_blocks(table: DataFrame, codec: str = "binary") -> DataFrame:
    """term, chunk_no (counted within its block), doc_id and tf of every chunk of every block."""
    return map_arrow(table.select("header", "body", "entries"), _Chunks(codec), "term string, chunk_no long, doc_id long, tf long")


class _Chunks:
    def __init__(self, codec: str):
        self.codec = codec

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for header, body, entries in zip(*(b.column(c).to_pylist() for c in ("header", "body", "entries"))):
                data = chunk_data(header, body)
                rows = pa.RecordBatch.from_arrays([pa.array([e["term"] for e in entries]), pa.array(range(len(data)), pa.int64()), pa.array(data, pa.binary())], ["term", "chunk_no", "data"])
                yield from _Decode(self.codec)([rows])


def encode_runs(parts: DataFrame, pieces: int = RUN_PARTS) -> DataFrame:
    """run, piece and data: the run codec over the lists of each run, cut in pieces by term. parts: run, term, doc_id, tf."""
    by = ["run", "piece"]
    rows = parts.select("run", F.pmod(F.xxhash64("term"), F.lit(pieces)).alias("piece"), "term", "doc_id", "tf").repartition(*by).sortWithinPartitions(*by, "term", "doc_id")
    return map_arrow(rows, _encode_runs, "run long, piece long, data binary")


def _encode_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by run, piece, term and doc_id: no more is held than a batch and a piece."""
    held: list[pa.RecordBatch] = []

    def out() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        run, piece, term, ids, freqs = rows.columns
        new = np.ones(rows.num_rows, bool)
        new[1:] = pc.not_equal(term.slice(1), term.slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False)
        # A document that comes more than once in a run has its counts added.
        ids = ids.to_numpy()
        kept = np.flatnonzero(new | (np.diff(ids, prepend=0) != 0))
        start = np.flatnonzero(new[kept])
        data = C.encode_run_lists(term.take(pa.array(kept[start])), ids[kept], np.add.reduceat(freqs.to_numpy(), kept), np.r_[start, len(kept)])
        yield pa.RecordBatch.from_arrays([run.slice(0, 1), piece.slice(0, 1), pa.array([data], pa.binary())], ["run", "piece", "data"])

    for b in batches:
        if not b.num_rows:
            continue
        run, piece = b.column("run").to_numpy(), b.column("piece").to_numpy()
        cut = [0, *(1 + np.flatnonzero((run[1:] != run[:-1]) | (piece[1:] != piece[:-1]))).tolist(), b.num_rows]
        for lo, hi in zip(cut, cut[1:]):
            part = b.slice(lo, hi - lo)
            if held and (held[-1].column("run")[0], held[-1].column("piece")[0]) != (part.column("run")[0], part.column("piece")[0]):
                yield from out()
                held = []
            held.append(part)
    if held:
        yield from out()


def _read_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for run, data in zip(b.column("run").to_pylist(), b.column("data").to_pylist()):
            terms, ids, freqs, at = C.decode_run_lists(data)
            owner = pa.array(np.repeat(np.arange(len(terms)), np.diff(at)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), run, np.int64)), terms.take(owner), pa.array(ids), pa.array(freqs)], ["run", "term", "doc_id", "tf"])


def read_runs(runs: DataFrame) -> DataFrame:
    """run, term, doc_id and tf of encoded runs."""
    return map_arrow(runs.select("run", "data"), _read_runs, "run long, term string, doc_id long, tf long")


def sizes(posts: DataFrame, size: int = CHUNK) -> DataFrame:
    """term, chunk_no, n, bytes under the chunk codec, and whether decoding gives the chunk back."""
    held = packed(posts, size)
    return map_arrow(held, _sized, "term string, chunk_no long, n long, bytes long, exact boolean")


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for made in _Encode("binary")([b]):
            data, want = made.column("data").to_pylist(), b.column("list").flatten()
            n, start = made.column("n").to_numpy(), np.r_[0, np.cumsum(b.column("list").value_lengths().to_numpy(zero_copy_only=False))][:-1]
            ids, freqs, at = _decoded("binary", data)
            if (np.diff(at) == n).all():
                exact = np.logical_and.reduceat((ids == want.field("doc_id").to_numpy()) & (freqs == want.field("tf").to_numpy()), start)
            else:
                exact = np.array([C.decode_chunk(d) == ([x["doc_id"] for x in chunk], [x["tf"] for x in chunk]) for d, chunk in zip(data, b.column("list").to_pylist())])
            yield pa.RecordBatch.from_arrays([made.column("term"), made.column("chunk_no"), made.column("n"), pa.array([len(d) for d in data], pa.int64()), pa.array(exact)], ["term", "chunk_no", "n", "bytes", "exact"])


def plain_dump(posts: DataFrame, size: int = CHUNK) -> DataFrame:
    """term, chunk_no and the debugging text of each chunk: term and length, ids, frequencies, a line each."""
    text = lambda f: F.concat_ws(" ", F.transform(F.col("list"), lambda x: x[f].cast("string")))
    return packed(posts, size).select("term", "chunk_no", F.concat_ws("\n", F.concat_ws(" ", "term", F.size("list").cast("string")), text("doc_id"), text("tf")).alias("dump"))
