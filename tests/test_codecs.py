import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import numpy as np

from corpusmith.operators import blocks as B
from corpusmith.operators import codecs as C

ASCENDING = st.lists(st.integers(0, 1 << 27), max_size=300, unique=True).map(sorted)
ANY = st.lists(st.integers(0, (1 << 63) - 1), max_size=200)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 16383, 16384, 1 << 28, 1 << 31, 1 << 40, (1 << 53) + 1, (1 << 62) + 12345, (1 << 63) - 1])
def test_varbyte(spark, n):
    assert C.read_varbyte(C.varbyte(n)) == (n, len(C.varbyte(n)))
    row = spark.createDataFrame([(n,)], "n long").select(C.varbyte_size(F.col("n")), C.width(F.col("n"))).first()
    assert tuple(row) == (len(C.varbyte(n)), n.bit_length())
    assert spark.createDataFrame([(n,)], "n long").select(C.varbyte_hex(F.col("n"))).first()[0] == C.varbyte(n).hex().upper()


def test_varbyte_layout():
    assert C.varbyte(0) == b"\x80" and C.varbyte(127) == b"\xff" and C.varbyte(128) == b"\x00\x81"
    with pytest.raises(ValueError):
        C.varbyte(-1)


@given(ANY)
@settings(max_examples=60, deadline=None)
def test_pack(values):
    assert C.unpack(C.pack(values)) == (values, len(C.pack(values)))


@given(ASCENDING)
@settings(max_examples=60, deadline=None)
def test_lists(values):
    for encode, decode in C.CODECS.values():
        assert decode(encode(values)) == values
    assert C.unsimple9(C.simple9(values))[0] == values


@pytest.mark.parametrize("n", [1, 2, 27, 28, 29, 127, 128, 129])
@pytest.mark.parametrize("gap", [0, 1, 1 << 14, (1 << 28) - 1])
def test_lengths_and_gaps(n, gap):
    values = [7 + i * gap for i in range(n)]
    assert C.undelta(C.delta(values, C.simple9), decode=C.unsimple9)[0] == values
    assert C.decode_chunk(C.encode_chunk(values, [i + 1 for i in range(n)])) == (values, [i + 1 for i in range(n)])


def test_simple9_words():
    assert len(C.simple9([1] * 28)) == 1 + 4 and len(C.simple9([1] * 29)) == 1 + 8 and len(C.simple9([])) == 1
    # Selector in the low four bits, items from there up.
    assert C.simple9([1, 0, 1]) == b"\x83" + (0 | 1 << 4 | 1 << 6).to_bytes(4, "little")
    assert C.simple9([300]) == b"\x81" + (6 | 300 << 4).to_bytes(4, "little") or C.LAYOUTS[6] != (3, 9)
    with pytest.raises(ValueError):
        C.simple9([1 << 28])


def test_header():
    assert C.decode_header(C.encode_header([10, 25, 90], [5, 200, 1 << 33], 90, 17)) == ([10, 25, 90], [5, 200, 1 << 33], 90, 17)
    assert C.decode_header(C.encode_header([], [], 0, 0)) == ([], [], 0, 0)


def test_sizes(spark):
    lists = {"a": ([3, 4, 400, 70000], [1, 2, 3, 300]), "b": ([0], [1])}
    posts = spark.createDataFrame([(t, d, f) for t, (ids, fs) in lists.items() for d, f in zip(ids, fs)], "term string, doc_id long, tf long")
    got = {r.term: r for r in C.list_sizes(posts).collect()}
    for t, (ids, fs) in lists.items():
        assert got[t].packed_bytes == len(C.delta(ids)) and got[t].freq_bytes == len(C.pack(fs))
        assert got[t].varbyte_bytes == sum(len(C.varbyte(g)) for g in [ids[0], *C.gaps(ids)])
    chunk = {r.term: r for r in B.sizes(posts).collect()}
    assert all(r.exact and r.bytes == len(C.encode_chunk(*lists[t])) for t, r in chunk.items())


@given(st.lists(st.tuples(st.text(max_size=8), ASCENDING.filter(len)), max_size=6))
@settings(max_examples=40, deadline=None)
def test_runs_and_lexicon(lists):
    run = [(t, ids, [i % 300 + 1 for i in range(len(ids))]) for t, ids in lists]
    assert C.decode_run(C.encode_run(run)) == run
    entries = [(t, ids[0] << 20, len(ids), ids[-1]) for t, ids in lists]
    assert C.decode_lexicon(C.encode_lexicon(entries)) == entries


@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 300), st.integers(0, (1 << 28) - 1)), max_size=130), max_size=6))
@settings(max_examples=60, deadline=None)
def test_many_lists_at_once(lists):
    at = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
    words, word_at = C.simple9_words(np.array([v for x in lists for v in x], np.int64), at)
    for i, x in enumerate(lists):
        assert C.varbyte(len(x)) + words[word_at[i] : word_at[i + 1]].tobytes() == C.simple9(x)
    with pytest.raises(ValueError):
        C.simple9_words(np.array([1 << 28]), np.array([0, 1]))


@given(st.lists(ASCENDING.filter(len), min_size=1, max_size=5))
@settings(max_examples=30, deadline=None)
def test_chunks_at_once(lists):
    freqs = [[i % 70_000 + 1 for i in x] for x in lists]
    at = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
    flat = [np.array([v for x in y for v in x], np.int64) for y in (lists, freqs)]
    for name, (encode, decode) in B.CHUNK_CODECS.items():
        data = encode(*flat, at)
        assert [decode(d) for d in data] == list(zip(lists, freqs))
        if name == "binary":
            assert data == [C.encode_chunk(x, f) for x, f in zip(lists, freqs)]


@pytest.fixture(scope="module")
def posts(spark):
    rng = np.random.default_rng(8)
    rows = [(f"t{t}", int(d), int(d % 9 + 1)) for t, n in enumerate((700, 129, 128, 1, 3)) for d in np.sort(rng.choice(10_000, n, replace=False))]
    return spark.createDataFrame(rows, "term string, doc_id long, tf long").repartition(5), sorted(rows)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("codec", ["binary", "plain"])
def test_blocks(spark, posts, codec):
    table, want = posts
    chunks = B.encode(table, 128, codec)
    assert rows(B.decode(chunks, codec).select("term", "doc_id", "tf")) == want
    made = B.blocks(chunks, 400)
    assert made.count() > 3 and rows(B.read_blocks(made, codec).select("term", "doc_id", "tf")) == want
    words = {r.term: r for r in B.lexicon(made).collect()}
    assert {t: r.df for t, r in words.items()} == {"t0": 700, "t1": 129, "t2": 128, "t3": 1, "t4": 3}
    cursor = 0
    for r in made.orderBy("cursor").collect():
        assert r.cursor == cursor
        cursor += 4 + len(r.header) + len(r.body)
    first = {t: (d, f) for t, d, f in reversed(want)}
    assert {r.term: (r.first_doc_id, r.first_tf) for r in B.opened(made, B.lexicon(made), codec).collect()} == first
    with pytest.raises(ValueError):
        B.encode(table, 128, "none such")


def test_chunks_are_read_alone(spark, posts, tmp_path):
    table, want = posts
    B.encode(table).repartitionByRange("term", "chunk_no").sortWithinPartitions("term", "chunk_no").write.parquet(str(tmp_path / "c"))
    chunks = spark.read.parquet(str(tmp_path / "c"))
    ids = [d for t, d, _ in want if t == "t0"]
    assert [r.doc_id for r in B.load_chunk(chunks, "t0", 2).orderBy("doc_id").collect()] == ids[256:384]
    assert B.load_chunk(chunks, "t0", 6).count() == B.load_chunk(chunks, "none", 0).count() == 0
    plan = B.load_chunk(chunks, "t0", 2)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,t0)" in plan and "EqualTo(chunk_no,2)" in plan
    probes = [("t0", k) for k in (0, ids[127], ids[127] + 1, ids[500], 10_000)] + [("none", 3), ("t3", 0), ("t0", 0)]
    want_geq = {(t, k): min((d for u, d, _ in want if u == t and d >= k), default=None) for t, k in probes}
    assert {(r.term, r.k): r.doc_id for r in B.next_geq(chunks, probes).collect()} == want_geq


def test_runs_as_bytes(spark, posts):
    table, want = posts
    parts = table.withColumn("run", (F.col("doc_id") % 3))
    assert rows(B.read_runs(B.encode_runs(parts, 2))) == sorted((d % 3, t, d, f) for t, d, f in want)


@pytest.mark.parametrize("n", [1, 7])
def test_numbers_along_lists_cross_ranges(spark, posts, n):
    """A list over many ranges, ranges of one term only, and of several."""
    from corpusmith.plans import ranges

    table, want = posts
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(n * 9))
        got = ranges.numbered(table, "doc_id", "tf").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    k, prev, total, expected = {}, {}, {}, []
    for t, d, f in want:
        k[t], total[t] = k.get(t, 0) + 1, total.get(t, 0) + f
        expected.append((t, d, f, k[t], prev.get(t), total[t]))
        prev[t] = d
    assert sorted((r.term, r.doc_id, r.tf, r.k, r.prev, r.total) for r in got) == expected
