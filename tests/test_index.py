"""The saved index: pieces of lists, merged in ranges."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from corpusmith.operators import blocks, codecs
from corpusmith.plans import index as ix
from corpusmith.sources import corpus as sources


def documents(spark, n=400, step=1, seed=3):
    """In no order of ids; a frequent term, others, and documents without any."""
    rng = np.random.default_rng(seed)
    rows = [(int(i) * step - 5 * step, f"u{i}", " ".join(["x"] * int(rng.integers(0, 3)) + [f"w{rng.integers(0, 40)}" for _ in range(rng.integers(0, 9))])) for i in rng.permutation(n)]
    return rows, spark.createDataFrame(rows, sources.SCHEMA).repartition(3)


@pytest.mark.parametrize("step", [1, 997, 1 << 33])
def test_saved_lists(spark, tmp_path, step):
    """Negative, dense and far ids; a list over several ranges."""
    rows, corpus = documents(spark, step=step)
    want, last = {}, {}
    for i, _, text in sorted(rows):
        words = text.split()
        for w in set(words):
            last[w] = [*last.get(w, []), i]
            want[w, i] = (words.count(w), len(words), len(last[w]), last[w][-2] if len(last[w]) > 1 else None)
    index = ix.save(corpus, str(tmp_path / "i"))
    assert {(r.term, r.doc_id): (r.tf, r.doc_length, r.k, r.prev) for r in index.lists.collect()} == want
    assert {(r.term, r.df) for r in index.lexicon.collect()} == {(w, len(x)) for w, x in last.items()}
    assert sorted(map(tuple, index.docs.collect())) == sorted((i, u, len(t.split())) for i, u, t in rows)
    assert sum(r.cf for r in index.lexicon.collect()) == index.stats.first().n_tokens == sum(len(t.split()) for _, _, t in rows)


def test_counting_is_bounded(monkeypatch):
    """However many documents a batch has, what is counted side by side is no more than SLICE tokens or one document."""
    monkeypatch.setattr(ix, "SLICE", 10)
    seen, distinct = [], ix.distinct
    monkeypatch.setattr(ix, "distinct", lambda part: seen.append(part.column("terms").flatten().to_pylist()) or distinct(part))
    words = [["a"] * k for k in (4, 6, 3, 25, 0, 1, 9, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(["u"] * 8), pa.array(words)], ["doc_id", "url", "terms"])
    assert sum(sum(b.column("tf").to_pylist()) for b in ix._counted([batch])) == 50
    assert sum(x for b in ix._pieces([batch]) for x in b.column("cf").to_pylist() if x) == 50
    assert sorted(len(x) for x in seen) == sorted([10, 3, 25, 10, 2] * 2)


@pytest.mark.parametrize("rows", [1, 2, 1000])
def test_pieces_of_many_slices(monkeypatch, rows):
    """Lists over several slices, pieces, buckets and batches, of documents in no order."""
    for name, size in (("SLICE", 20), ("PIECE", 3), ("FLAT", 7)):
        monkeypatch.setattr(ix, name, size)
    ids = np.random.default_rng(1).permutation(60) * 5000 - 9000
    words = [["a"] * (i % 3) + [f"w{i % 7}"] for i in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[k : k + 25]), pa.array(["u"] * len(ids[k : k + 25])), pa.array(words[k : k + 25])], ["doc_id", "url", "terms"]) for k in (0, 25, 50)]
    pieces = pa.Table.from_batches(ix._pieces(batches))
    assert max(x for x in pieces.column("df").to_pylist() if x) <= 3
    lists = pieces.filter(pc.is_valid(pieces.column("term"))).sort_by([("term", "ascending"), ("bucket", "ascending")])
    found = [r for b in ix._Flat().flat(lists.to_batches(max_chunksize=rows)) for r in b.to_pylist()]
    want = sorted((w, int(i), t.count(w), len(t)) for i, t in zip(ids, words) for w in set(t))
    assert [(r["term"], r["doc_id"], r["tf"], r["doc_length"]) for r in found] == want


@pytest.mark.parametrize("seed", range(4))
def test_many_chunks_decoded_together(seed):
    """As one by one: widths of frequencies, gaps of any layout, single ids and empty chunks."""
    rng = np.random.default_rng(seed)
    data, want = [], []
    for n in [0, 1, 2, 128, 0, *rng.integers(1, 129, 40)]:
        ids = np.cumsum(rng.integers(1, 1 << int(rng.integers(1, 28)), n)).tolist()
        tfs = rng.integers(1, 1 << int(rng.integers(1, 40)), n).tolist()
        want.append((ids, tfs))
        data.append(codecs.encode_chunk(ids, tfs) if n else b"")
    ids, tfs, at = codecs.decode_chunks(b"".join(data), np.cumsum([len(d) for d in data]))
    assert [(ids[lo:hi].tolist(), tfs[lo:hi].tolist()) for lo, hi in zip(at[:-1], at[1:])] == want == [codecs.decode_chunk(d) for d in data]
    assert [len(x) for x in codecs.decode_chunks(b"", np.zeros(0, int))] == [0, 0, 1]


def test_gaps_along_chunks_and_ranges(spark, monkeypatch):
    """A list of many chunks in no order gives its ids back; what is sorted is a row a chunk."""
    ids = {"a": list(range(-7, 4000, 3)), "b": [5], "c": list(range(0, 1 << 40, 1 << 31))}
    rows = [(t, k + 1, i - (x[k - 1] if k else 0)) for t, x in ids.items() for k, i in enumerate(x)]
    sorted_rows, numbered = [], codecs.ranges.numbered
    monkeypatch.setattr(codecs.ranges, "numbered", lambda df, *a: sorted_rows.append(df.count()) or numbered(df, *a))
    found = codecs.gap_decoded(spark.createDataFrame(rows, "term string, k long, gap long").repartition(5)).collect()
    assert sorted((r.term, r.doc_id) for r in found) == sorted((t, i) for t, x in ids.items() for i in x)
    assert sorted_rows == [sum(-(-len(x) // 128) for x in ids.values())]


@pytest.mark.parametrize("seed", range(3))
def test_runs_of_lists_side_by_side(seed):
    """Byte for byte as list by list."""
    rng = np.random.default_rng(seed)
    run = []
    for t in ["", "é" * 70, *(f"t{i}" for i in range(rng.integers(0, 400)))][seed == 0 and 2 or 0 :]:
        n = int(rng.integers(1, 9))
        ids = np.cumsum(rng.integers(1, 1 << int(rng.integers(1, 40)), n)).tolist()
        run.append((t, ids, rng.integers(1, 1 << int(rng.integers(1, 40)), n).tolist()))
    at = np.r_[0, np.cumsum([len(x) for _, x, _ in run])].astype(np.int64)
    flat = [np.array([v for r in run for v in r[k]], np.int64) for k in (1, 2)]
    data = codecs.encode_run_lists(pa.array([r[0] for r in run], pa.string()), *flat, at)
    assert data == codecs.encode_run(run)
    terms, ids, freqs, at = codecs.decode_run_lists(data)
    assert [(t, ids[lo:hi].tolist(), freqs[lo:hi].tolist()) for t, lo, hi in zip(terms.to_pylist(), at[:-1], at[1:])] == run == codecs.decode_run(data)


def test_a_run_adds_a_document_that_comes_twice(spark):
    corpus = spark.createDataFrame([(1, "u", "a b a"), (1, "u", "a"), (2, "u", "b")], sources.SCHEMA)
    found = blocks.read_runs(blocks.encode_runs(ix.partial_postings(corpus, F.col("doc_id") * 0)))
    assert sorted(map(tuple, found.collect())) == [(0, "a", 1, 3), (0, "b", 1, 1), (0, "b", 2, 1)]
