"""AND and OR queries with BM25, top k and explanations.

A query's terms are filtered at the postings scan; lexicon rows join by broadcast,
as they are as few as the terms, and the one row of statistics is two constants. Postings hold
their document's length, so a query reads its own terms' rows and nothing that
grows with all documents. The best k come from a bounded sort.

Terms that the lexicon lacks are skipped, also by AND; an AND query without any
known term is an error, an OR query is then empty. Scores are rounded to six
digits before they are ordered, and ties go to the least doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmith.functions.tokenize import query_words
from corpusmith.plans.index import Index
from corpusmith.sources.corpus import point

K1, B, TOP = 1.2, 0.75, 10


class NoSuchTerms(ValueError):
    """An AND query has no term that the lexicon knows."""


def term_info(index: Index, query: str) -> DataFrame:
    """term and df of the query's terms that are known."""
    return index.lexicon.where(F.col("term").isin(*query_words(query))).select("term", "df")


def term_scores(index: Index, query: str) -> DataFrame:
    """doc_id, term, tf and BM25 score of every posting of the query's terms."""
    words = query_words(query)
    posts = index.postings.where(F.col("term").isin(*words)) if words else index.postings.where("false")
    known = F.broadcast(index.lexicon.where(F.col("term").isin(*words)).select("term", "df")) if words else index.lexicon.where("false").select("term", "df")
    rows = posts.join(known, "term")
    one = index.stats.first()
    idf = F.ln((F.lit(one["n_docs"]) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("doc_length") / F.lit(one["avgdl"]).cast("double"))
    return rows.select("doc_id", "term", "tf", (idf * F.lit(K1 + 1) * F.col("tf") / (norm + F.col("tf"))).alias("s"))


def _sums(scores: DataFrame) -> DataFrame:
    return scores.groupBy("doc_id").agg(F.round(F.sum("s"), 6).alias("score"), F.count("*").alias("n_terms"))


def disjunctive(index: Index, query: str) -> DataFrame:
    """doc_id, score and n_terms of every document with any of the terms."""
    return _sums(term_scores(index, query))


def conjunctive(index: Index, query: str) -> DataFrame:
    """The same, of documents with all of the terms that are known."""
    known = term_info(index, query).count()
    if not known:
        raise NoSuchTerms(query)
    return _sums(term_scores(index, query)).where(F.col("n_terms") == known)


def top(results: DataFrame, k: int = TOP) -> DataFrame:
    return results.orderBy(F.desc("score"), "doc_id").limit(k)


def explained(index: Index, query: str, best: DataFrame) -> DataFrame:
    """doc_id, term, score and freq of each term of each of the best."""
    rows = term_scores(index, query).join(F.broadcast(best.select("doc_id")), "doc_id")
    return rows.select("doc_id", "term", F.round("s", 6).alias("term_score"), F.col("tf").alias("freq"))


def fetched(best: DataFrame, corpus: DataFrame, docs: DataFrame) -> DataFrame:
    """The best k with url, length and content. Their ids, k of them, go to both scans as a filter."""
    rows = best.collect()
    ids = [r["doc_id"] for r in rows]
    held = F.broadcast(best.sparkSession.createDataFrame(rows, best.schema))
    return point(docs, *ids).join(held, "doc_id").join(point(corpus, *ids).select("doc_id", "content"), "doc_id").select("doc_id", "url", "doc_length", "score", "content")
