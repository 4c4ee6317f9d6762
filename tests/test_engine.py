import math

import pytest
from pyspark.sql import functions as F

from corpusmith.functions.tokenize import index_terms, query_terms, query_words
from corpusmith.operators import lists, search, snippets
from corpusmith.plans import index as ix
from corpusmith.plans import queries
from corpusmith.sources import corpus as sources

from .compare import assert_same, save

QUERY_SIGNS = list(""" ,.:;?[]{}()-/+*&^"'\n""")
INDEX_SIGNS = QUERY_SIGNS + list("@!#%><|~") + list("，。（）·～？》《｜、；：「」【】“’")
NO_SIGNS = ["\t", "\r", "_", "=", "$", "\\", "`", "”", "‘", "！", " "]


def terms(spark, texts, f):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f("t")).collect()]


def test_every_delimiter(spark):
    assert all(x == ["a", "b"] for x in terms(spark, [f"a{d}b" for d in INDEX_SIGNS], index_terms))
    assert all(x == ["a", "b"] for x in terms(spark, [f"a{d}b" for d in QUERY_SIGNS], query_terms))
    assert all(x == [f"a{d}b"] for x, d in zip(terms(spark, [f"a{d}b" for d in NO_SIGNS], index_terms), NO_SIGNS))
    only_index = [d for d in INDEX_SIGNS if d not in QUERY_SIGNS]
    assert all(x == [f"a{d}b"] for x, d in zip(terms(spark, [f"a{d}b" for d in only_index], query_terms), only_index))


def test_query_tokens(spark):
    texts = ["b a b", "foo!", "C++", "", " ,. ", "Case case"]
    assert terms(spark, texts, query_terms) == [query_words(t) for t in texts] == [["a", "b"], ["foo!"], ["C"], [], [], ["Case", "case"]]


@pytest.fixture(scope="module")
def mini(spark):
    rows = [(0, "u0", "all red fish"), (1, "u1", "all red red bird!"), (2, "u2", "all blue\n"), (3, "u3", " ,."), (4, "u4", "all twin word"), (5, "u5", "all twin word")]
    corpus = spark.createDataFrame(rows, sources.SCHEMA)
    return corpus, ix.build(corpus)


def test_bm25_by_hand(mini):
    _, index = mini
    got = {r.doc_id: r.score for r in search.disjunctive(index, "red all").collect()}
    length, n = {0: 3, 1: 4, 2: 2, 3: 0, 4: 3, 5: 3}, 6
    average = sum(length.values()) / n

    def score(df, tf, d):
        k = 1.2 * (0.25 + 0.75 * length[d] / average)
        return math.log((n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (k + tf)

    for d, tf in ((0, 1), (1, 2)):
        assert got[d] == pytest.approx(score(2, tf, d) + score(5, 1, d), abs=1e-6)
    # A term in more than half of the documents lowers a score, and an empty document counts in the average.
    assert got[2] == pytest.approx(score(5, 1, 2), abs=1e-6) and got[2] < 0
    assert set(got) == {0, 1, 2, 4, 5}


def test_and_skips_unknown_terms(mini):
    _, index = mini
    assert {r.doc_id for r in search.conjunctive(index, "red nothere all").collect()} == {0, 1}
    assert search.disjunctive(index, "nothere").count() == 0
    assert search.disjunctive(index, " , ").count() == 0
    for q in ("nothere", "", "bird!"):
        with pytest.raises(search.NoSuchTerms):
            search.conjunctive(index, q)


def test_ties_go_to_the_least_id(mini):
    _, index = mini
    assert [r.doc_id for r in search.top(search.disjunctive(index, "twin"), 1).collect()] == [4]
    assert [r.doc_id for r in search.top(search.disjunctive(index, "twin twin")).collect()] == [4, 5]


def test_empty_corpus(spark):
    index = ix.build(spark.createDataFrame([], sources.SCHEMA))
    assert index.postings.count() == index.lexicon.count() == 0
    assert index.stats.collect()[0][:2] == (0, 0)
    assert search.disjunctive(index, "a").count() == 0


def test_lists_across_chunks(spark):
    corpus = spark.createDataFrame([(3 * i, "u", "x") for i in range(300)], sources.SCHEMA)
    index = ix.build(corpus)
    assert sorted((r.chunk_no, r.first_doc_id, r.last_doc_id, r.n) for r in ix.chunks(index.postings).collect()) == [(0, 0, 381, 128), (1, 384, 765, 128), (2, 768, 897, 44)]
    probes = [("x", 0), ("x", 381), ("x", 382), ("x", 897), ("x", 898), ("y", 0)]
    assert {(r.term, r.k): r.doc_id for r in lists.next_geq(index, probes).collect()} == dict(zip(probes, [0, 381, 384, 897, None, None]))
    assert {(r.term, r.doc_id): r.tf for r in lists.get_freq(index, [("x", 3), ("x", 4), ("y", 3)]).collect()} == {("x", 3): 1, ("x", 4): None, ("y", 3): None}


def segment(spark, content, words):
    hits = spark.createDataFrame([(1, w, s) for w, s in words.items()], "doc_id long, term string, term_score double")
    found = snippets.segments(hits, spark.createDataFrame([(1, content)], "doc_id long, content string"))
    return [(r.start_pos, r.end_pos, r.score, r.text) for r in found.orderBy("start_pos").collect()]


def by_hand(content, words):
    """The walk over the text that the segments are defined by."""
    text, out, start = content + "\n", [], 0
    for i, c in enumerate(text):
        if c in QUERY_SIGNS:
            word = text[start:i]
            if word in words:
                a, b = max(0, start - 100), min(i + 100, len(text) - 1)
                if not out or out[-1][1] < a:
                    out.append([a, b, words[word]])
                else:
                    out[-1][1], out[-1][2] = b, out[-1][2] + words[word]
            start = i + 1
    return [(a, b, round(s, 6), text[a : b + 1]) for a, b, s in out]


@pytest.mark.parametrize("gap", [0, 1, 50, 199, 200, 201, 202, 203, 204, 260])
def test_snippets_merge_when_they_touch(spark, gap):
    words = {"hit": 1.5, "other": -0.25}
    content = "hit " + "z" * gap + " other" + " y" * 140 + ".hit"
    assert segment(spark, content, words) == by_hand(content, words)


def test_snippets_without_hits(spark):
    assert segment(spark, "hits hit's", {"hits'": 1.0}) == []
    assert segment(spark, "", {"x": 1.0}) == []


def test_run_assignment_is_greedy(spark):
    sizes = [5, 7, 3, 20, 1, 1, 9, 9]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, bytes long")
    got = [r.run for r in ix.assigned_runs(rows, 10).orderBy("doc_id").collect()]
    want, run, held = [], 0, 0
    for s in sizes:
        want.append(run)
        held += s
        if held >= 10:
            run, held = run + 1, 0
    assert got == want


def test_merge_adds_a_document_of_two_runs(spark):
    parts = spark.createDataFrame([(0, "a", 1, 2), (1, "a", 1, 3), (1, "a", 2, 1)], "run long, term string, doc_id long, tf long")
    assert sorted(map(tuple, ix.merged(parts).collect())) == [("a", 1, 5), ("a", 2, 1)]


TREC = "<DOC>\n<DOCNO>D1</DOCNO>\n\n<TEXT>\nhttp://one\nline a\n\nline b\n</TEXT>\n</DOC>\n<DOC>\n<DOCNO>D2</DOCNO>\n<TEXT>\n\nhttp://two\n</TEXT>\n</DOC>\n"


def test_trec(spark, tmp_path):
    good = tmp_path / "good"
    good.write_text(TREC + "<DOC>\n<DOCNO>D3</DOCNO>\n<TEXT>\n</TEXT>\n</DOC>\n")
    assert sorted(map(tuple, sources.trec(spark, str(good)).collect())) == [(0, "http://one", "line a\nline b\n"), (1, "http://two", "")]
    bad = tmp_path / "bad"
    bad.write_text("<DOC>\n<TEXT>\nhttp://x\n</TEXT>\n</DOC>\n" + TREC)
    with pytest.raises(Exception, match="malformed"):
        sources.trec(spark, str(bad)).collect()
    assert sorted(r.doc_id for r in sources.trec(spark, str(bad), strict=False).collect()) == [1, 2]


TREC_CASES = {
    # Carriage returns are kept, empty lines skipped, a tag within the text is content, what follows a tag on its line is ignored.
    "odd": ("<DOC> x\n\n<DOCNO>1</DOCNO>\n<TEXT>\nu\na\rb\r\n\n</DOC>\n <TEXT>\n</TEXT> rest\n\n</DOC> tail\n", [(0, "u", "a\rb\r\n</DOC>\n <TEXT>\n")]),
    "ends within a text": ("<DOC>\n<DOCNO>1\n<TEXT>\nu\nx\n</TEXT>\n</DOC>\n<DOC>\n<DOCNO>2\n<TEXT>\nv\nrest", [(0, "u", "x\n"), (1, "v", "rest\n")]),
    "ends within a head": ("<DOC>\n<DOCNO>1\n<TEXT>\nu\n</TEXT>\n</DOC>\n<DOC>\n<DOCNO>2\n", [(0, "u", "")]),
    "ends before a close": ("<DOC>\n<DOCNO>1\n<TEXT>\nu\n</TEXT>", [(0, "u", "")]),
    "no url ends all": ("<DOC>\n<DOCNO>1\n<TEXT>\nu\n</TEXT>\n</DOC>\n<DOC>\n<DOCNO>2\n<TEXT>\n</TEXT>\n</DOC>\n<DOC>\n<DOCNO>3\n<TEXT>\nw\n</TEXT>\n</DOC>\nbad\n", [(0, "u", "")]),
    "empty": ("", []),
    "blank": ("\n\n", []),
}


@pytest.mark.parametrize("case", TREC_CASES)
def test_trec_lines(spark, tmp_path, case):
    text, want = TREC_CASES[case]
    (tmp_path / "f").write_bytes(text.encode())
    assert sorted(map(tuple, sources.trec(spark, str(tmp_path / "f")).collect())) == want


ONE = "<DOC>\n<DOCNO>1\n<TEXT>\nu\nx\n</TEXT>\n</DOC>\n"


@pytest.mark.parametrize("text,left", [
    (ONE + ONE.replace("<DOCNO>", "<NO>") + ONE, [0, 2]),
    (ONE.replace("</DOC>", "more") + ONE, [0]),
    (ONE + "stray\n" + ONE, [0]),
    ("<DOC>\n</TEXT>\n</DOC>\n" + ONE, [1]),
    (ONE + "stray\n", [0]),
    (ONE.replace("</DOC>\n", "stray\n"), [0]),
])
def test_malformed_trec(spark, tmp_path, text, left):
    (tmp_path / "f").write_text(text)
    with pytest.raises(Exception, match="malformed"):
        sources.trec(spark, str(tmp_path / "f")).collect()
    assert sorted(r.doc_id for r in sources.trec(spark, str(tmp_path / "f"), strict=False).collect()) == left


def test_trec_files_one_after_the_other(spark, tmp_path):
    for k, text in enumerate((ONE * 3, "", ONE * 2 + "<DOC>\n<DOCNO>9\n<TEXT>\nv\nopen", ONE)):
        (tmp_path / f"f{k}").write_text(text)
    assert sorted((r.doc_id, r.url) for r in sources.trec(spark, str(tmp_path)).collect()) == [(0, "u"), (1, "u"), (2, "u"), (3, "u"), (4, "u"), (5, "v"), (6, "u")]


def test_held_list(mini):
    _, index = mini
    held = lists.Held(index, "all")
    assert held.rows.count() == 5
    held.clear()
    assert held.rows.count() == 5
    held.close()
    with pytest.raises(ValueError):
        held.rows


def test_first_part(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"))
    assert sources.first_part(docs, 0.01).count() == 2 and sources.first_part(docs) is docs and sources.first_part(docs, 0).count() == 0
    with pytest.raises(ValueError):
        sources.first_part(docs, 2)


def test_store(spark, tmp_path):
    store = sources.Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(i, f"u{i}", 1, "x") for i in range(10)], "doc_id long, url string, doc_length long, content string")
    store.add(rows.where("doc_id < 5"))
    store.add(rows.where("doc_id >= 5"))
    assert store.count() == 10
    assert [r.url for r in store.get(7).collect()] == ["u7"] and store.get(11).count() == 0 and store.get().count() == 0
    assert {r.doc_id for r in store.between(3, 6).collect()} == {3, 4, 5}


def test_saved_index_reads_only_the_terms(spark, tmp_path):
    corpus = spark.createDataFrame([(i, "u", f"a{i % 7} b{i}") for i in range(50)], sources.SCHEMA)
    index = ix.save(corpus, str(tmp_path / "index"))
    plan = index.postings.where(F.col("term").isin("a1", "b2"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [a1,b2])]" in plan
    assert index.lexicon.where("term = 'a1'").collect()[0].df == 7


def test_trec_keeps_ids_with_gaps(spark, tmp_path):
    """Ids that aren't dense from 0, and texts without a filled line."""
    rows = [(5, "a b"), (70, "\n\n"), (1000, ""), (1001, "x\n\ny\n"), (2_000_000, "z")]
    save(spark, str(tmp_path), documents=spark.createDataFrame(rows, "doc_id long, text string"))
    assert_same(queries.trec_parse(spark, str(tmp_path)), str(tmp_path), queries.SQL["trec_parse"])
