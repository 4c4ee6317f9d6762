import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmith.llm import language_id as L
from corpusmith.llm import textops as T

from .fixtures import awkward, clashing, empty

RANKS = {bytes([b]): b for b in range(256)} | {p: 256 + k for k, p in enumerate((b" a", b"ab", b"abc", b"bc", b" ab", b"ca", b"\xc3\xa9", b"a\xc3"))}


def brute(unit, texts, prob):
    """The sum over all segmentations, one by one."""
    if not unit:
        return 1.0
    return sum(prob[texts[unit[:n]]] * brute(unit[n:], texts, prob) for n in range(1, len(unit) + 1) if unit[:n] in texts)


@pytest.mark.parametrize("words", [["abc", "a", "abcabca", "é", "zaé"], ["cab"], ["x" * 9, "ab" * 5]])
def test_forward_sums_all_segmentations(words):
    v = L.piece_table(RANKS)
    prob = np.random.default_rng(1).random((v.total, 2))
    w = T.words(pa.array([" ".join(words)]), T.SPACED)
    one, _ = L.distinct(w)
    scores = L.word_scores(w, one, v, prob)
    for row, k in zip(scores, one):
        unit = b" " + w.data[w.starts[k] : w.ends[k]].tobytes()
        for lang in range(2):
            assert row[lang] == pytest.approx(math.log(brute(unit, v.texts, prob[:, lang])), abs=1e-9)
        assert np.allclose(L.long_unit(unit, v, prob), row)


def test_expected_counts(monkeypatch):
    v = L.piece_table(RANKS)
    prob = np.random.default_rng(2).random(v.total)
    data = np.frombuffer(b"abcaab", np.uint8)
    lat = L.lattice(data, np.array([0, 4]), np.array([4, 6]), v)
    got = L.expected(lat, prob, np.array([3.0, 2.0]))

    def every(unit):
        if not unit:
            return [[]]
        return [[unit[:n], *rest] for n in range(1, len(unit) + 1) if unit[:n] in v.texts for rest in every(unit[n:])]

    want = np.zeros(v.total)
    for unit, weight in ((b" abca", 3.0), (b" ab", 2.0)):
        ways = every(unit)
        p = np.array([np.prod([prob[v.texts[x]] for x in way]) for way in ways])
        for way, share in zip(ways, p / p.sum() * weight):
            for x in way:
                want[v.texts[x]] += share
    assert np.allclose(got, want)


def test_long_words_are_scored_whole():
    v = L.piece_table(RANKS)
    prob = np.full((v.total, 1), 0.01)
    long = L.long_unit(b" " + b"abc" * 5000, v, prob)[0]
    # A regular text: each further period multiplies the sum by the same factor.
    a, b = (L.long_unit(b" " + b"abc" * n, v, prob)[0] for n in (1000, 2000))
    assert long == pytest.approx(b + 3 * (b - a), rel=1e-9)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.train(docs.where("doc_id % 2 = 0"), docs_each=60)
    rows = L.identified(docs.where("doc_id % 2 = 1"), model).join(docs.select("doc_id", "lang"), "doc_id").where("n_words >= 20").collect()
    assert len(rows) > 300 and sum(r.language == r.lang for r in rows) >= 0.98 * len(rows)


def test_bound_on_training(spark):
    docs = spark.createDataFrame([(i, "the same text", "en") for i in range(30)] + [(99, "otro texto", "es")], "doc_id long, text string, lang string")
    one = L.train(docs, docs_each=5)
    assert one.languages == ["en", "es"] and np.allclose(one.prob.sum(0), 1)
    assert np.allclose(one.prob, L.train(docs.unionByName(docs), docs_each=5).prob)


def test_awkward_rows(spark):
    model = L.train(spark.createDataFrame([(1, "words in english", "en"), (2, "mots en français", "fr"), (3, None, "de"), (None, "x", "en"), (4, "y", None)], "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fr"]
    for docs in (awkward(spark), clashing(awkward(spark))):
        rows = L.identified(docs, model).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert (r.language is None) == (r.n_words == 0) and math.isfinite(r.log_likelihood) and r.margin >= 0
    assert L.identified(empty(spark), model).count() == 0
    none = L.train(empty(spark))
    assert none.languages == [] and {r.language for r in L.identified(awkward(spark), none).collect()} == {None}
    same = L.Model(["a", "b"], np.repeat(model.prob[:, :1], 2, axis=1))
    assert {r.language for r in L.identified(awkward(spark).where(F.col("doc_id") == 0), same).collect()} == {"a"}


@pytest.mark.parametrize("size", [1, 7, 48, 90])
def test_long_units_count_as_short_ones(size):
    rng = np.random.default_rng(size)
    ranks = {bytes([b]): b for b in range(256)} | {p: 256 + k for k, p in enumerate((b"ab", b"abc", b" a", b"bca", b"cabcab", b"aaaa"))}
    v = L.piece_table(ranks)
    prob = rng.dirichlet(np.ones(v.total))
    word = bytes(rng.choice(list(b"abc"), size).tolist())
    lat = L.lattice(np.frombuffer(word, np.uint8), np.array([0]), np.array([size]), v)
    out = np.zeros(v.total)
    L.long_expected(b" " + word, v, {x[:k] for x in v.texts for k in range(1, len(x) + 1)}, prob, 3, out)
    assert np.allclose(out, L.expected(lat, prob, np.array([3.0])))


def test_very_long_units_train(spark):
    texts = [("x", "日本語の文章です" * 400), ("y", "今天天气很好我们" * 400), ("x", "z" * 30_000)]
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    model = L.train(docs)
    got = {r.doc_id: r.language for r in L.identified(docs, model).collect()}
    assert got == {0: "x", 1: "y", 2: "x"}
    # Learned pieces are far from uniform.
    assert (model.prob.max(axis=0) > 0.02).all()
    total = np.zeros(model.prob.shape[0])
    v = L.pieces()
    L.long_expected(b" " + texts[1][1].encode(), v, {x[:k] for x in v.texts for k in range(1, len(x) + 1)}, model.prob[:, 1], 1, total)
    assert sum(total[r] * len(p) for p, r in v.texts.items()) == pytest.approx(1 + len(texts[1][1].encode()), rel=1e-6)
