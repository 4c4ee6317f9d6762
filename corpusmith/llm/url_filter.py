"""URL filter: logistic regression on hashed character n-grams of host and path.

The classifier is trained from a small labelled table of URLs; a URL's host and
path give overlapping n-grams of 2 to 4 characters with a mark at either end,
tagged by part and hashed to FEATURES columns. All of it runs in built-in
expressions and Spark ML, also training.

Defined results: a null or empty URL, or one without a host, has a null score
and isn't dropped; repeated rows are scored each; scheme, query and fragment
don't count; very long URLs are scored whole; other columns are not read; an empty
table gives an empty one. Labelled rows with a null url or label, or without a host,
don't train; at the bound of labelled rows, rows of one url are interchangeable but
for their labels, of which the lesser goes first. A labelled table with one class
only can't train and raises ValueError.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES, SIZES, THRESHOLD = 1 << 16, (2, 3, 4), 0.8
#: Rows of the labelled table that train at most, those whose md5(url) is least.
LABELLED_BOUND = 100_000

#: Words of hosts and paths by general knowledge of the web, drawn up without any crawled or test table.
_BAD_WORDS = ("casino", "poker", "betting", "jackpot", "slots", "viagra", "cialis", "pharmacy", "pills", "steroids", "porn", "sex", "adult", "xxx", "escort", "nude", "webcam", "cams", "hookup", "singles", "payday", "loans", "forex", "bitcoin-doubler", "replica", "knockoff", "warez", "keygen", "cracked", "torrent", "spam", "linkfarm", "backlinks", "followers", "clickbait", "lottery", "sweepstakes", "giveaway", "diet-pill", "weightloss")
_BAD_MORE = ("cheap", "free", "online", "best", "hot", "buy", "win", "bonus", "discount", "deals", "instant", "farm", "4u", "x", "now", "vip")
_GOOD_WORDS = ("library", "museum", "university", "school", "college", "council", "gazette", "herald", "journal", "archive", "hospital", "clinic", "theatre", "orchestra", "garden", "cooking", "astronomy", "geology", "history", "physics", "railway", "harbour", "weather", "football", "chess", "sailing", "cycling", "hiking", "architecture", "translation", "software", "database", "encyclopedia", "dictionary", "parliament", "ministry", "charity", "church", "bakery", "bookshop")
_GOOD_MORE = ("north", "river", "city", "old", "green", "national", "daily", "notes", "guide", "society", "club", "open", "house", "blog", "wiki", "institute")
_BAD_PATHS = ("/win-prize", "/bonus/signup", "/free-download.exe", "/xxx/live-cams", "/offer/click-here", "/cheap/order-now", "/promo/no-deposit", "/hot/singles-near-you")
_GOOD_PATHS = ("/articles/rivers-of-europe", "/research/papers/17", "/guide/planting-trees", "/council/minutes/2019", "/reference/manual", "/events/spring-concert", "/lessons/grammar", "/history/timeline")
#: Paths that say nothing, in both classes.
_PATHS = ("", "/", "/index.html", "/2019/05/14/", "/page/3", "/p/48213", "/de/", "/view.php")
_ENDS = ("com", "org", "net", "info", "co.uk", "de")


def seed_table(spark: SparkSession) -> DataFrame:
    """A small labelled table (url, label) of made-up hosts; label 1 is to be dropped."""
    rows = []
    for label, some, more, paths in ((1, _BAD_WORDS, _BAD_MORE, _BAD_PATHS), (0, _GOOD_WORDS, _GOOD_MORE, _GOOD_PATHS)):
        for k, word in enumerate(some):
            for j in range(6):
                other = more[(3 * k + 5 * j) % len(more)]
                host = (f"{other}-{word}", f"{word}-{other}", f"{word}{other}")[(k + j) % 3]
                path = paths[(k * 5 + j) % len(paths)] if j % 3 == 0 else _PATHS[(k + 3 * j) % len(_PATHS)]
                rows.append((f"{('http', 'https')[(k + j) % 2]}://{('', 'www.', 'm.', 'blog.')[(k + 3 * j) % 4]}{host}.{_ENDS[(k + j) % len(_ENDS)]}{path}", label))
    return spark.createDataFrame(rows, "url string, label int")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (lower case, without port and user) and path."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(found), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def grams(text: Column, tag: str, sizes: tuple[int, ...] = SIZES) -> Column:
    """Tagged n-grams of ^text$. Each size comes from the one below by adding a character, so the work is linear."""
    chars = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
    out, now = [], chars
    for n in range(2, max(sizes) + 1):
        now = F.zip_with(now, F.slice(chars, n, F.greatest(F.size(chars) - n + 1, F.lit(0))), lambda a, b: F.concat(a, b))
        now = F.filter(now, lambda g: g.isNotNull())
        if n in sizes:
            out.append(F.transform(now, lambda g: F.concat(F.lit(tag), g)))
    return F.concat(*out)


def featured(urls: DataFrame, column: str = "url") -> DataFrame:
    """Adds to each row, held whole in a struct, its host and n-grams."""
    host, path = parts(F.coalesce(urls[column], F.lit("")))
    rows = urls.select(F.struct(*[urls[c] for c in urls.columns]).alias("row"), host.alias("host"), path.alias("path"))
    return rows.withColumn("grams", F.when(F.col("host") != "", F.concat(grams(F.col("host"), "h"), grams(F.col("path"), "p"))).otherwise(F.array().cast("array<string>")))


def train(labelled: DataFrame, bound: int = LABELLED_BOUND, rounds: int = 60, regularisation: float = 0.002) -> PipelineModel:
    rows = labelled.where("url is not null and label is not null").orderBy(F.md5(F.col("url").cast("binary")), "label").limit(bound)
    ready = featured(rows).where("host <> ''").select(F.col("row.label").cast("double").alias("label"), "grams")
    if ready.select("label").distinct().count() < 2:
        raise ValueError("the labelled table needs both classes")
    steps = [HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True), LogisticRegression(maxIter=rounds, regParam=regularisation, standardization=False)]
    return Pipeline(stages=steps).fit(ready)


def scored(pages: DataFrame, model: PipelineModel, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, host, score (probability of label 1) and drop of each row. A narrow pass that reads two columns."""
    rows = featured(pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url")))
    out = model.transform(rows.select("row", "host", "grams"))
    score = F.when(F.col("host") != "", F.round(vector_to_array("probability")[1], 9))
    return out.select("row.page_id", "row.url", "host", score.alias("score")).withColumn("drop", F.coalesce(F.col("score") >= threshold, F.lit(False)))


def filtered_urls(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    return scored(pages, train(seed_table(pages.sparkSession) if labelled is None else labelled))
