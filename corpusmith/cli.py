"""The three programs: build an index, rebuild it in a better document order, and answer queries.

    python -m corpusmith.cli build   docs.trec  out/            # or a Parquet table of doc_id and text
    python -m corpusmith.cli reorder out/       reordered/
    python -m corpusmith.cli query   out/

query reads three lines again and again: the query, 0 for AND (anything else: OR), 0 for no snippets. An empty query ends it.
Flags of a program can stand in a file, a line each (--chunk_length=64), named by --flagfile.
"""

from __future__ import annotations

import argparse
import sys
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.functions.shared import drop_written
from corpusmith.operators import blocks, reorder, search, snippets
from corpusmith.plans import index as ix
from corpusmith.sources import corpus as sources
from corpusmith.sources import dumps


def build(spark: SparkSession, source: str, out: str, strict: bool = True, encoding: str = "none", chunk_length: int = ix.CHUNK, block_bytes: int = blocks.BLOCK_BYTES, fraction: float = 1.0) -> ix.Index:
    """The index and the document store; with an encoding also the lists as blocks of chunks, and the lexicon's cursors as text."""
    corpus = sources.from_table(spark.read.parquet(source), "doc_id", "text") if source.rstrip("/").endswith(".parquet") else sources.trec(spark, source, strict)
    corpus.write.parquet(f"{out}/store")
    index = ix.save(sources.first_part(spark.read.parquet(f"{out}/store"), fraction), out)
    _encoded(index, out, encoding, chunk_length, block_bytes)
    return index


def _encoded(index: ix.Index, out: str, encoding: str, chunk_length: int, block_bytes: int) -> None:
    if encoding == "none":
        return
    table = blocks.blocks(blocks.encode(index.lists, chunk_length, encoding), block_bytes)
    table.write.parquet(f"{out}/blocks")
    dumps.write_lexicon(blocks.lexicon(table), f"{out}/lexicon_table")
    dumps.write_doc_table(index.docs, f"{out}/doc_table")
    drop_written(table)


def rebuild(spark: SparkSession, source: str, out: str, ordering: str = "bisect", encoding: str = "none", chunk_length: int = ix.CHUNK, block_bytes: int = blocks.BLOCK_BYTES) -> ix.Index:
    """The index of source under new ids; the store and all tables carry them."""
    order = reorder.STRATEGIES[ordering](ix.load(spark, source)).select(F.col("old_id").alias("doc_id"), "new_id")
    store = spark.read.parquet(f"{source}/store").join(order, "doc_id").select(F.col("new_id").alias("doc_id"), "url", "content")
    store.write.parquet(f"{out}/store")
    index = ix.save(spark.read.parquet(f"{out}/store"), out)
    _encoded(index, out, encoding, chunk_length, block_bytes)
    return index


def answer(index: ix.Index, corpus: DataFrame, query: str, every: bool, with_snippets: bool, out: TextIO, k: int = search.TOP) -> int:
    """Prints terms, ranked documents, what each term gave, and snippets; the number of documents."""
    for r in search.term_info(index, query).orderBy("term").collect():
        print(f"term {r.term}: in {r.df} documents", file=out)
    try:
        found = search.conjunctive(index, query) if every else search.disjunctive(index, query)
    except search.NoSuchTerms:
        print("no term of the query is known", file=out)
        return -1
    ranked = search.top(found, k).collect()
    best = index.docs.sparkSession.createDataFrame(ranked, found.schema)
    lengths = {r.doc_id: r for r in sources.point(index.docs, *(r.doc_id for r in ranked)).collect()}
    parts: dict[int, list] = {}
    rows = search.explained(index, query, best) if ranked else best.where("false")
    for r in rows.collect():
        parts.setdefault(r.doc_id, []).append(r)
    texts: dict[int, list] = {}
    if with_snippets and ranked:
        for r in snippets.segments(rows, sources.point(corpus, *(r.doc_id for r in ranked))).orderBy("doc_id", "segment").collect():
            texts.setdefault(r.doc_id, []).append(r.text)
    for n, r in enumerate(ranked, 1):
        print(f"{n}. document {r.doc_id} ({lengths[r.doc_id].url}, {lengths[r.doc_id].doc_length} terms): {r.score}", file=out)
        for p in sorted(parts.get(r.doc_id, []), key=lambda p: p.term):
            print(f"   {p.term}: {p.term_score}, {p.freq} times", file=out)
        for t in texts.get(r.doc_id, []):
            print(f"   ... {t.strip()} ...", file=out)
    return len(ranked)


def repl(spark: SparkSession, path: str, lines: TextIO = sys.stdin, out: TextIO = sys.stdout, k: int = search.TOP) -> None:
    index, corpus = ix.load(spark, path), spark.read.parquet(f"{path}/store")
    while query := lines.readline().rstrip("\n"):
        mode, texts = lines.readline().strip(), lines.readline().strip()
        answer(index, corpus, query, mode == "0", texts != "0", out, k)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--flagfile", action="append", default=[], help="a file of flags, a line each")
    programs = p.add_subparsers(dest="what", required=True)
    for name in ("build", "reorder", "query"):
        q = programs.add_parser(name)
        q.add_argument("source")
        q.add_argument("--flagfile", action="append", default=[], help="a file of flags, a line each")
        if name == "query":
            q.add_argument("--k", type=int, default=search.TOP, help="documents that a query shows")
            continue
        q.add_argument("out")
        q.add_argument("--encoding", choices=("none", *blocks.CHUNK_CODECS), default="none", help="also write the lists as blocks of chunks in this code")
        q.add_argument("--chunk_length", type=int, default=ix.CHUNK, help="postings of a chunk")
        q.add_argument("--block_bytes", type=int, default=blocks.BLOCK_BYTES, help="bytes of a block of chunks")
        if name == "build":
            q.add_argument("--lenient", action="store_true", help="leave malformed records out")
            q.add_argument("--fraction", type=float, default=1.0, help="index this part of the documents, of the least ids")
        else:
            q.add_argument("--ordering", choices=[*reorder.STRATEGIES], default="bisect")
    return p


def parsed(args: list[str]) -> argparse.Namespace:
    """Arguments with those of flag files, which the ones given go before."""
    p = parser()
    found = p.parse_args(args)
    flags = []
    for path in found.flagfile:
        with open(path, encoding="utf-8") as f:
            flags += [x.strip() for x in f if x.strip() and not x.startswith("#")]
    return p.parse_args([found.what, *flags, *args[args.index(found.what) + 1 :]]) if flags else found


def main() -> None:
    args = parsed(sys.argv[1:])
    spark = SparkSession.builder.appName("corpusmith").getOrCreate()
    if args.what == "query":
        repl(spark, args.source, k=args.k)
    elif args.what == "build":
        build(spark, args.source, args.out, not args.lenient, args.encoding, args.chunk_length, args.block_bytes, args.fraction)
    else:
        rebuild(spark, args.source, args.out, args.ordering, args.encoding, args.chunk_length, args.block_bytes)


if __name__ == "__main__":
    main()
