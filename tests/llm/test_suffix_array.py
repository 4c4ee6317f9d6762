import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmith.llm import suffix_array as S

from ..compare import assert_same, save
from .fixtures import DOCUMENTS, awkward, clashing, documents, empty


def brute(texts, threshold=S.THRESHOLD):
    """{(doc, start, stop, removed)} by all passages of so many words."""
    where = {}
    for d, t in enumerate(texts):
        w = (t or "").split()
        for i in range(len(w) - threshold + 1):
            where.setdefault(tuple(w[i : i + threshold]), []).append((d, i))
    out = set()
    for removed in (False, True):
        marks = {}
        for places in where.values():
            if len(places) > 1:
                for d, i in places[removed:]:
                    marks.setdefault(d, set()).update(range(i, i + threshold))
        for d, m in marks.items():
            starts = [i for i in m if i - 1 not in m]
            out |= {(d, i, next(j for j in range(i, i + len(m) + 1) if j not in m), removed) for i in starts}
    return out


def got(df):
    return {(r.doc_id, r.start_word, r.end_word, r.removed) for r in df.collect()}


PIECES = st.lists(st.lists(st.sampled_from([("p", 0, 49), ("p", 0, 50), ("p", 0, 51), ("p", 10, 90), ("p", 0, 140), ("q", 0, 70), ("u", 0, 5), ("x", 0, 60), ("x", 0, 40)]), max_size=4), min_size=1, max_size=6)


def made(spec):
    fresh = iter(range(10**9))
    word = {"p": lambda i: f"p{i}", "q": lambda i: f"q{i}", "u": lambda i: f"u{next(fresh)}", "x": lambda i: "x"}
    return [" ".join(word[k](i) for k, lo, hi in parts for i in range(lo, hi)) for parts in spec]


@given(PIECES)
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_against_all_passages(spark, spec):
    texts = made(spec)
    # Runs that touch are one run by definition of what is covered.
    assert got(S.repeated_passages(documents(spark, texts))) == brute(texts)


def test_random_texts(spark):
    rng = random.Random(2)
    pool = [f"w{i}" for i in range(300)]
    source = [rng.choice(pool) for _ in range(3000)]
    texts = [" ".join([*(f"n{d}_{i}" for i in range(rng.randint(0, 30))), *source[(a := rng.randint(0, 2900)) : a + rng.randint(30, 120)], *(f"m{d}_{i}" for i in range(9))]) for d in range(80)]
    texts += [texts[3], texts[3], texts[9] + " more"]
    assert got(S.repeated_passages(documents(spark, texts))) == brute(texts)


@pytest.mark.parametrize("threshold", [2, 3, 20, 75])
def test_thresholds(spark, tmp_path, threshold):
    rng = random.Random(threshold)
    pool = [f"w{i}" for i in range(2000)]
    source = [rng.choice(pool) for _ in range(1500)]
    texts = [" ".join([*(f"n{d}_{i}" for i in range(9)), *source[(a := rng.randint(0, 1400)) : a + rng.randint(10, 130)], f"m{d}"]) for d in range(50)]
    docs = documents(spark, texts)
    found = S.repeated_passages(docs, threshold)
    assert got(found) == brute(texts, threshold)
    save(spark, tmp_path, documents=docs)
    assert_same(found, tmp_path, S.runs_sql("documents", threshold))


def test_rounds():
    assert S.rounds(50) == (16, [16, 18]) and S.rounds(75) == (32, [32, 11]) and S.rounds(20) == (8, [8, 4]) and S.rounds(2) == (1, [1]) and S.rounds(3) == (1, [1, 1])
    for threshold in range(2, 300):
        seed, steps = S.rounds(threshold)
        depth = seed
        for step in steps:
            assert 0 < step <= depth
            depth += step
        assert depth == threshold
    with pytest.raises(ValueError):
        S.rounds(1)


def test_edges_of_ranges(spark):
    edges = [(0, 1, 1, 2), (5, 2, 2, 1), (100, 2, 2, 9), (200, 2, 2, 3), (207, 3, 3, 1), (300, 4, 4, 1)]
    schema = "rank long, a long, b long, n long"
    found = {tuple(r) for r in S.whole_groups(spark.createDataFrame(edges, schema)).collect()}
    assert found == {(0, 0, 2), (5, 5, 13), (100, 5, 13), (200, 5, 13), (207, 207, 1), (300, 300, 1)}
    assert S.whole_groups(spark.createDataFrame([], schema)).isEmpty()


def test_a_passage_in_a_tenth_of_all_documents_spreads(spark, monkeypatch):
    """Many small ranges: groups go on over several of them, and none holds much more than its share."""
    monkeypatch.setattr(S, "SORT_BYTES", 36 * 300)
    passage = " ".join(f"p{i}" for i in range(55))
    rng = random.Random(7)
    texts = [" ".join([*(f"n{d}_{i}" for i in range(rng.randint(1, 90))), *([passage] if d % 10 == 0 else [])]) for d in range(900)]
    texts += [" ".join(f"q{d % 40}_{i}" for i in range(60)) + f" end{d}" for d in range(120)]
    docs = documents(spark, texts)
    sizes = []

    def ranked(pairs):
        parts = -(-pairs.count() // 300)
        order = ("a", "b", "did", "th", "pos")
        counts = [r["count"] for r in pairs.repartitionByRange(parts, *order).groupBy(F.spark_partition_id()).count().collect()]
        sizes.append((max(counts), sorted(counts)[len(counts) // 2]))
        return of(pairs)

    of = S._ranked
    monkeypatch.setattr(S, "_ranked", ranked)
    assert got(S.repeated_passages(docs)) == brute(texts)
    assert len(sizes) == 3
    assert all(most < 2 * middle for most, middle in sizes)


def test_cut(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = documents(spark, [f"one  {passage}\nend", f" two\t{passage}  tail\n", passage, "nothing here", None])
    rows = {r.doc_id: (r.text, r.n_chars) for r in S.cut(docs).collect()}
    assert rows == {0: (f"one  {passage}\nend", len(passage) + 9), 1: (" two\ttail\n", 10), 3: ("nothing here", 12), 4: (None, None)}


def test_query_sql(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = documents(spark, [passage, passage + " x", passage, None, "", "y " * 70])
    save(spark, tmp_path, documents=docs)
    assert_same(S.repeated_passages(docs), tmp_path, S.runs_sql())


def test_awkward_rows(spark):
    plain = awkward(spark)
    for docs in (plain, clashing(plain)):
        kept = S.cut(docs)
        assert kept.columns == docs.columns and [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema]
        # Only the text of one word over and over is repeated, within itself: its last words go.
        assert kept.count() == docs.count()
        changed = {r.doc_id for r in kept.exceptAll(docs).collect()}
        assert changed == {3}
    assert S.cut(empty(spark)).count() == S.repeated_passages(empty(spark)).count() == 0


def test_repeated_rows_and_ids(spark):
    long = " ".join(f"a{i}" for i in range(55))
    rows = [(1, long), (1, long), (2, "b " + long), (None, long), (1, "c " + long)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCUMENTS)
    # The document without an id comes first in order, so it keeps the passage.
    left = sorted((r.doc_id is None, r.text) for r in S.cut(docs).collect())
    assert left == [(False, "b "), (False, "c "), (True, long)]
    alone = docs.where(F.col("doc_id") == 1).where(F.col("text") == long)
    assert S.cut(alone).count() == 2 and S.repeated_passages(alone).count() == 0
