"""Small tables with every awkward row: nulls, empty and very long texts, repeated rows, ties, clashing names."""

from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHES = ("did", "th", "row", "t", "h", "k", "key", "keys", "f0", "f1", "m", "n", "pos", "start", "stop", "removed", "rep", "check", "gone", "fail_bits", "n_words", "solid", "plain", "lines", "tokens", "obs", "path", "part")


def awkward(spark):
    rows = [(0, "some plain words here", "en", "a", 21), (1, None, "en", "a", None), (2, "", None, "a", 0), (None, "no id at all", "en", None, 12), (None, None, None, None, None), (3, "word " * 30000, "en", "a", 150000), (4, "twice the same row", "en", "a", 18), (4, "twice the same row", "en", "a", 18), (5, " \n\t ", "en", "a", 4), (6, "x" * 70000, "en", "a", 70000), (7, "éß日本 \U0001f600 ok", "fr", "b", 10)]
    return spark.createDataFrame(rows, DOCUMENTS)


def clashing(docs):
    return docs.withColumns({c: F.lit("clash") for c in CLASHES})


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def documents(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCUMENTS)
