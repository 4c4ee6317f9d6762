import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmith.llm import bpe

from .fixtures import awkward, clashing, empty


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(bpe.VOCABULARY)


@given(st.text(alphabet="abst 'l\n\t\r.!é1 2日\x1c  \U0001f600", max_size=160), st.sampled_from([1, 2, 7, 33]))
@settings(max_examples=300, deadline=None)
def test_tree_equals_whole(text, leaf):
    c = bpe.codec(bpe.VOCABULARY)
    whole = c._encoding.encode_ordinary(text)
    assert c.encode(text, leaf) == whole
    assert c.decode(whole, leaf).decode() == text


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 20_000, "word " * 20_000, "\n" * 9_000 + "x", "日本" * 9_000, "it's we'll they've " * 3_000, "<|endoftext|> " * 2_000])
def test_long_texts(codec, text):
    assert codec.encode(text, 997) == codec._encoding.encode_ordinary(text)
    assert codec.decode(codec.encode(text), 100).decode() == text


def test_pattern_is_the_vocabulary_s():
    import public_tokenizers

    assert bpe.PATTERN == public_tokenizers.PATTERN
    assert isinstance(bpe.codec(bpe.VOCABULARY)._encoding, tiktoken.Encoding)


def test_round_trip_of_a_table(spark, codec):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokens = bpe.encoded(docs, leaf=500)
    rows = tokens.collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts) and all(r.exact and r.n_tokens == len(r.tokens) for r in rows)
    assert all(r.tokens == codec._encoding.encode_ordinary(texts[r.doc_id]) for r in rows)
    assert {r.doc_id: r.text for r in bpe.decoded(tokens, leaf=50).collect()} == texts


def test_awkward_rows(spark):
    for docs in (awkward(spark), clashing(awkward(spark))):
        rows = bpe.encoded(docs).collect()
        texts = sorted((r.text is not None, r.text or "") for r in docs.collect())
        back = sorted((r.text is not None, r.text or "") for r in bpe.decoded(bpe.encoded(docs)).collect())
        assert texts == back
        assert all((r.tokens is None) == (r.n_tokens is None) == (r.exact is None) for r in rows)
    assert bpe.encoded(empty(spark)).count() == 0
