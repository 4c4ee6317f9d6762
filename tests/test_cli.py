import io

from corpusmith import cli
from corpusmith.sources import dumps


def test_build_reorder_and_query(spark, tmp_path):
    docs = "".join(f"<DOC>\n<DOCNO>D{i}</DOCNO>\n<TEXT>\nhttp://d/{i}\nshared word{i % 3} text\n</TEXT>\n</DOC>\n" for i in range(9))
    source = tmp_path / "docs.trec"
    source.write_text(docs)
    cli.build(spark, str(source), str(tmp_path / "one"))
    cli.rebuild(spark, str(tmp_path / "one"), str(tmp_path / "two"))
    said = []
    for folder in ("one", "two"):
        out = io.StringIO()
        cli.repl(spark, str(tmp_path / folder), io.StringIO("word1 shared\n0\n1\nword1 nothere\n1\n0\nnothere\n0\n0\n\nnot read\n"), out)
        said.append(out.getvalue())
    for text in said:
        assert text.count("document ") == 6 and text.count("... shared word1 text ...") == 3
        assert "term shared: in 9 documents" in text and text.endswith("no term of the query is known\n")
    urls = lambda t: sorted(w for w in t.replace("(", " ").replace(",", " ").split() if w.startswith("http"))
    assert urls(said[0]) == urls(said[1])


def test_text_forms(spark, tmp_path):
    rows = [(0, "http://a b", 3), (1, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, url string, doc_length long")
    dumps.write_doc_table(docs, str(tmp_path / "d"))
    assert sorted(map(tuple, dumps.read_doc_table(spark, str(tmp_path / "d")).collect())) == rows
    lexicon = [("a\tb", 2), ("c\rd", 1), ("x", 10)]
    dumps.write_lexicon(spark.createDataFrame(lexicon, "term string, df long"), str(tmp_path / "l"))
    assert sorted(map(tuple, dumps.read_lexicon(spark, str(tmp_path / "l")).collect())) == lexicon


def test_flags_and_encodings(spark, tmp_path):
    from corpusmith.operators import blocks

    docs = "".join(f"<DOC>\n<DOCNO>D{i}</DOCNO>\n<TEXT>\nhttp://d/{i}\nshared word{i % 3} text\n</TEXT>\n</DOC>\n" for i in range(9))
    (tmp_path / "docs.trec").write_text(docs + "<DOC>\nbad\n</TEXT>\n")
    (tmp_path / "flags").write_text("# of a build\n--chunk_length=2\n--encoding=plain\n--lenient\n")
    args = cli.parsed(["build", str(tmp_path / "docs.trec"), str(tmp_path / "a"), "--flagfile", str(tmp_path / "flags"), "--encoding", "binary"])
    assert (args.chunk_length, args.encoding, args.lenient, args.fraction) == (2, "binary", True, 1.0)
    index = cli.build(spark, args.source, args.out, not args.lenient, args.encoding, args.chunk_length, 64)
    table = spark.read.parquet(f"{args.out}/blocks")
    want = sorted((r.term, r.doc_id, r.tf) for r in index.postings.collect())
    assert sorted((r.term, r.doc_id, r.tf) for r in blocks.read_blocks(table).collect()) == want and table.count() > 1
    words = dumps.read_lexicon(spark, f"{args.out}/lexicon_table", cursors=True)
    assert {r.term: r.df for r in words.collect()}["shared"] == 9
    assert {r.term: r.first_doc_id for r in blocks.opened(table, words).collect()}["word1"] == 1
    again = cli.rebuild(spark, args.out, str(tmp_path / "b"), "identity", "plain")
    assert sorted((r.term, r.doc_id, r.tf) for r in blocks.read_blocks(spark.read.parquet(str(tmp_path / "b" / "blocks")), "plain").collect()) == want == sorted((r.term, r.doc_id, r.tf) for r in again.postings.collect())
    part = cli.build(spark, args.source, str(tmp_path / "c"), False, fraction=0.5)
    assert part.docs.count() == 4
    out = io.StringIO()
    cli.repl(spark, args.out, io.StringIO("shared\n1\n0\n\n"), out, cli.parsed(["query", "x", "--k", "2"]).k)
    assert out.getvalue().count("document ") == 2


def test_urls_with_a_line_feed(spark, tmp_path):
    dumps.write_doc_table(spark.createDataFrame([(0, "a\nb", 3)], "doc_id long, url string, doc_length long"), str(tmp_path / "d"))
    assert [tuple(r) for r in dumps.read_doc_table(spark, str(tmp_path / "d")).collect()] == [(0, "a b", 3)]
