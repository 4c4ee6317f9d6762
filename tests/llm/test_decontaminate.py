import random
import re

import pytest

from corpusmith.llm import decontaminate as D
from corpusmith.llm import textops as T

from ..compare import assert_same, save
from .fixtures import awkward, clashing, documents, empty


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def brute(docs, benchmark, threshold=D.THRESHOLD):
    """Every window of every document against every item."""
    toks = lambda t: [w for w in re.split(T.ALNUM_GAP, (t or "").lower()) if w]
    out = {}
    for k, item in enumerate(benchmark):
        iw = toks(item)
        n = min(D.SHINGLE, len(iw))
        if not n:
            continue
        want = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
        for d, text in enumerate(docs):
            dw = toks(text)
            grams = [tuple(dw[i : i + n]) for i in range(len(dw) - n + 1)]
            best = max(((len(want & {*grams[s : s + len(iw) - n + 1]}), -s) for s in range(len(grams)) if grams[s] in want), default=(0, 0))
            if best[0] and best[0] >= threshold * len(want) - 1e-9:
                out[d, k] = (best[0], len(want), -best[1])
    return out


def got(df):
    return {(r.doc_id, r.item_id): (r.n_shared, r.n_shingles, r.start_word) for r in df.collect()}


@pytest.mark.parametrize("threshold", [0.3, 0.8, 1.0])
def test_against_every_window(spark, threshold):
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(12)]
    benchmark = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(12)] + [None, "", "?!", "w1 w1 w1 w1 w1 w1 w1 w1", "Same Item words go here now", "same item, WORDS go here now."]
    docs = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    docs += [f"x y {b} z" for b in benchmark if b] + [" ".join(benchmark[0].split()[:-1]), None, "", "w1 " * 200]
    a, b = documents(spark, docs), items(spark, benchmark)
    want = brute(docs, benchmark, threshold)
    assert got(D.contaminated(a, b, threshold)) == want and want
    # Beyond the limit of what is sent to executors the shingles are joined.
    assert D.matches(a, b, threshold, limit=0).count() == len(want)


def test_query_sql(spark, tmp_path):
    docs, b = documents(spark, ["a b c d e f g h", "A, b c d e f g!", None, "", "b c d e f g h i j"]), items(spark, ["a b c d e f g", "b c", None, "zz"])
    save(spark, tmp_path, documents=docs, benchmark=b)
    assert_same(D.contaminated(docs, b), tmp_path, D.contaminated_sql())


def test_clean_documents_stay(spark):
    leak = "the quick brown fox jumps over the lazy dog tonight again"
    docs = documents(spark, [f"before {leak.upper()}, after", "the quick brown fox met the lazy dog", "nothing at all"])
    assert sorted(r.doc_id for r in D.clean(docs, items(spark, [leak])).collect()) == [1, 2]


def test_awkward_rows(spark):
    b = items(spark, ["twice the same row", None])
    for docs in (awkward(spark), clashing(awkward(spark))):
        kept = D.clean(docs, b)
        assert kept.columns == docs.columns and kept.count() == docs.count() - 2
        assert got(D.contaminated(docs, b.withColumns({"pos": b.item_id, "h": b.item_id}))) == {(4, 0): (1, 1, 0)}
        assert D.clean(docs, b.where("false")).count() == docs.count()
    assert D.clean(empty(spark), b).count() == 0
