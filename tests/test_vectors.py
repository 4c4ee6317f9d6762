"""Centroids and cosines from the texts themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmith.operators import vectors
from corpusmith.plans import index as ix
from corpusmith.plans import queries
from corpusmith.sources import corpus as sources


@pytest.fixture(scope="module")
def corpus(spark):
    """Ids with gaps in no order, some without a term."""
    rng = np.random.default_rng(6)
    rows = [(int(i) * 7 - 100, "u", " ".join(f"w{k}" for k in rng.integers(0, 30, rng.integers(0, 12)))) for i in rng.permutation(120)]
    return spark.createDataFrame(rows, sources.SCHEMA).repartition(5)


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_each_with_the_next(spark, corpus, batch):
    """As by the join on pairs, over slices, batches and ranges."""
    ids = sorted(r.doc_id for r in corpus.select("doc_id").collect())
    pairs = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    want = {(r.a, r.b): r.cosine for r in vectors.cosines(pairs, vectors.term_vectors(ix.postings(corpus))).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = {(r.a, r.b): r.cosine for r in vectors.next_cosines(corpus).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found.keys() == want.keys()
    assert all(found[k] == (None if want[k] is None else pytest.approx(want[k])) for k in want) and None in found.values()


def test_no_pair(spark, corpus):
    for n in (0, 1):
        assert vectors.next_cosines(corpus.limit(n)).count() == 0


def test_centroids_of_texts(corpus):
    docs = corpus.withColumn("side", (F.col("doc_id") % 3 == 0).cast("int"))
    want = {(r.side, r.term): r.weight for r in vectors.centroids(vectors.term_vectors(ix.postings(corpus)), docs.select("doc_id", "side")).collect()}
    assert {(r.side, r.term): r.weight for r in vectors.text_centroids(docs).collect()} == pytest.approx(want)


@pytest.mark.parametrize("name", ["centroid", "order_cluster", "cosine_pairs"])
def test_no_index_is_needed(spark, monkeypatch, name):
    monkeypatch.setattr(queries, "_index", lambda *_: 1 / 0)
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()
