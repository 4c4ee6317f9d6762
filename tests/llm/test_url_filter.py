import pytest
from pyspark.sql import functions as F

from corpusmith.llm import url_filter as U

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def model(spark):
    return U.train(U.seed_table(spark))


def test_grams(spark):
    row = spark.createDataFrame([("abc", "/x")], "a string, b string").select(U.grams(F.col("a"), "h"), U.grams(F.col("b"), "p", (3,))).first()
    text = "^abc$"
    assert row[0] == [f"h{text[i : i + n]}" for n in (2, 3, 4) for i in range(len(text) - n + 1)]
    assert row[1] == ["p^/x", "p/x$"]


def test_parts(spark):
    urls = ["https://User:pw@WWW.Example.com:80/a/B?q=1#f", "http://host", "ftp://h/p#x", "no scheme/path", "", None, "http:///p"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(*(p for p in U.parts(F.coalesce("u", F.lit("")))))
    assert [tuple(r) for r in rows.collect()] == [("www.example.com", "/a/B"), ("host", ""), ("h", "/p"), ("", ""), ("", ""), ("", ""), ("", "/p")]


def test_held_out_accuracy(spark):
    """Hosts are held out whole, so no n-gram of a host's own rows helps."""
    rows = U.seed_table(spark).withColumn("host", F.regexp_extract("url", r"://(?:www\.|m\.|blog\.)?([^.]+)", 1)).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(4)))
    right = total = 0
    for fold in range(4):
        m = U.train(rows.where(F.col("fold") != fold).select("url", "label"))
        held = rows.where(F.col("fold") == fold).select(F.lit(0).alias("page_id"), "url", "label")
        truth = {r.url: r.label for r in held.collect()}
        for r in U.scored(held, m, 0.5).collect():
            right += r.drop == bool(truth[r.url])
            total += 1
    assert total == rows.count() and right >= 0.85 * total


def test_unwanted_hosts(spark, model):
    urls = ["http://cheap-pills.other.com/en/1", "https://casino-bonus-win.example.net/x", "https://www.city-library.example.org/events", "http://blog.sailing-notes.example.com/2021/rivers"]
    rows = U.scored(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), model).orderBy("page_id").collect()
    assert [r.drop for r in rows] == [True, True, False, False]


def test_awkward_rows(spark, model):
    long = "http://a.example.com/" + "path/" * 20000
    pages = spark.createDataFrame([(1, None, "x"), (2, "", None), (None, "http://b.example.com", "x"), (3, "nothing", "x"), (4, long, "x"), (5, "http://b.example.com", "x"), (5, "http://b.example.com", "x")], PAGES)
    for table in (pages, pages.withColumns({c: F.lit("clash") for c in ("host", "path", "grams", "features", "row", "score", "probability", "label", "rawPrediction", "prediction", "drop")})):
        rows = U.scored(table, model).collect()
        assert len(rows) == 7
        for r in rows:
            assert (r.score is None) == (not r.host) and (r.host or not r.drop)
        assert len({r.score for r in rows if r.url == "http://b.example.com"}) == 1
    assert U.scored(pages.where("false"), model).count() == 0
    with pytest.raises(ValueError):
        U.train(U.seed_table(spark).where("label = 1"))
    with pytest.raises(ValueError):
        U.train(U.seed_table(spark).where("false"))


def murmur3(data, seed=42):
    """The public 32-bit hash of that name, x86 variant."""
    m = 0xFFFFFFFF
    rot = lambda x, r: (x << r | x >> 32 - r) & m
    h = seed
    for i in range(0, len(data) - 3, 4):
        k = rot(int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
        h = (rot(h ^ k, 13) * 5 + 0xE6546B64) & m
    tail = data[len(data) & ~3 :]
    if tail:
        h ^= rot(int.from_bytes(tail, "little") * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_scores_by_brute_force(spark, model):
    """Every page of the small table: n-grams, hashing and the logistic score again, from the coefficients alone."""
    import math
    import re

    logistic = model.stages[-1]
    weights, intercept = logistic.coefficients.toArray(), logistic.intercept
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = U.scored(pages, model).collect()
    assert len(rows) == pages.count()
    for r in rows:
        m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)", r.url or "")
        if not m or not m[1]:
            assert r.score is None and not r.drop
            continue
        texts = (("h", f"^{m[1].lower()}$"), ("p", f"^{m[2]}$"))
        found = {tag + t[i : i + n] for tag, t in texts for n in U.SIZES for i in range(len(t) - n + 1)}
        columns = {murmur3(g.encode()) % U.FEATURES for g in found}
        score = 1 / (1 + math.exp(-intercept - sum(weights[c] for c in columns)))
        assert r.score == pytest.approx(score, abs=1e-8) and r.drop == (r.score >= U.THRESHOLD)
