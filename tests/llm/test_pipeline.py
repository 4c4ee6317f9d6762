"""The pipeline against a brute-force version that goes document by document, and each stage on awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from corpusmith.llm import bpe, quality_rules, simhash, suffix_array

from ..compare import rows_of, save
from .fixtures import DOCUMENTS, awkward, clashing, empty
from .test_decontaminate import brute as leaks
from .test_simhash import brute as pairs_of
from .test_simhash import edited, groups_of
from .test_suffix_array import brute as repeats


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    parts = ("ka", "lo", "mi", "ter", "ne", "sol", "va", "rin", "cu", "des", "po", "gra", "thi")
    pool = [f"{a}{b}{c}" for a in parts for b in parts for c in parts]
    prose = lambda n: [rng.choice(pool) + rng.choice(("", "", "", ",", ".")) for _ in range(n)]
    base = [prose(rng.randint(60, 160)) for _ in range(30)]
    passage = " ".join(prose(70))
    bench = [" ".join(prose(25)) for _ in range(3)]
    texts = [" ".join(b) for b in base]
    texts += [texts[k] for k in (0, 0, 1)] + [edited(base[k], rng, 0.04) for k in (2, 3, 3)]
    texts += [" ".join(prose(40)) + "\n" + passage + "\n" + " ".join(prose(40)) for _ in range(3)]
    texts += [" ".join(prose(50)) + " " + bench[k] + " " + " ".join(prose(30)) for k in range(3)]
    texts += ["same " * 90, (" ".join(prose(70))).upper(), " ".join(prose(60)) + " you idiot moron scum", None, ""]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("corpus"))
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    save(spark, path, documents=spark.createDataFrame(rows, DOCUMENTS), benchmark=spark.createDataFrame(list(enumerate(bench)), "item_id long, text string"), labels=labels)
    return path, {i: t for i, t in enumerate(texts)}, bench


def without(text, spans):
    """The text without words start to stop of each span, each with the white space after it."""
    import re

    lead = re.match(r"\s*", text).group()
    pieces = re.findall(r"\S+\s*", text)
    gone = {i for a, b in spans for i in range(a, b)}
    return lead + "".join(p for i, p in enumerate(pieces) if i not in gone)


def by_brute_force(spark, texts, bench):
    frame = lambda t: spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in t.items()], DOCUMENTS)
    bad = {"same " * 90}
    kept = {i: t for i, t in texts.items() if t and t not in bad and not t.isupper() and "idiot" not in t}
    pairs, ids = pairs_of(frame(kept))
    kept = {i: t for i, t in kept.items() if i not in groups_of(pairs, ids)}
    order = sorted(kept)
    spans = {}
    for d, a, b, removed in repeats([kept[i] for i in order]):
        if removed:
            spans.setdefault(order[d], []).append((a, b))
    kept = {i: without(t, spans[i]) if i in spans else t for i, t in kept.items()}
    kept = {i: t for i, t in kept.items() if t.split()}
    order = sorted(kept)
    hit = {order[d] for d, _ in leaks([kept[i] for i in order], bench)}
    return {i: t for i, t in kept.items() if i not in hit}


def test_against_brute_force(spark, corpus):
    path, texts, bench = corpus
    want = by_brute_force(spark, texts, bench)
    rows = P.run(spark, path).collect()
    codec = bpe.codec(bpe.VOCABULARY)
    assert {r.doc_id: r.tokens for r in rows} == {i: codec._encoding.encode_ordinary(t) for i, t in want.items()}
    assert len(rows) == len(want) and all(r.exact for r in rows)
    # Something fell to every stage, and plain documents did not.
    assert {4, 5, 6, 7, 8, 36} <= want.keys() and not {30, 31, 32, 33, 34, 35, 39, 40, 41, 42, 43, 44, 45, 46} & want.keys()


def test_stages_are_five_and_in_order():
    assert [n for n, _ in P.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "byte_level_bpe"]


@pytest.mark.parametrize("k", range(5))
def test_stages_on_awkward_rows(spark, corpus, k):
    path, *_ = corpus
    name, stage = P.STAGES[k]
    for docs in (awkward(spark), clashing(awkward(spark)), empty(spark), clashing(empty(spark))):
        out = stage(spark, docs, path)
        if k < 4:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert out.count() <= docs.count()
        if docs.isEmpty():
            assert out.count() == 0
        elif k in (1, 2, 3):
            assert {0, 6, 7} <= {r.doc_id for r in out.collect()}


def test_stages_without_their_tables_rows(spark, corpus, tmp_path):
    path, *_ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    save(spark, tmp_path, documents=docs.where("false"), benchmark=spark.read.parquet(f"{path}/benchmark.parquet").where("false"), labels=spark.read.parquet(f"{path}/labels.parquet").where("false"))
    assert P.run(spark, str(tmp_path)).count() == 0
    assert P.decontamination(spark, docs, str(tmp_path)).count() == docs.count()
    assert P.quality(spark, docs, str(tmp_path)).count() == quality_rules.keep(docs).count()


def test_order_of_rows_does_not_matter(spark, corpus):
    path, *_ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    mixed = docs.orderBy(F.rand(5)).repartition(5)
    for f in (simhash.keep_one, suffix_array.cut):
        assert rows_of(f(docs)) == rows_of(f(mixed))
