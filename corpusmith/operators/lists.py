"""Primitives on one inverted list. Each is a filter on term that reaches the Parquet scan, where row groups outside of it are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmith.plans.index import Index


def open_lists(index: Index, terms: list[str]) -> DataFrame:
    """term, df and whether the lexicon has it, for each of terms."""
    asked = index.lexicon.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
    known = index.lexicon.where(F.col("term").isin(*terms))
    return asked.join(known, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"), F.col("df").isNotNull().alias("known"))


def load_all(index: Index, term: str) -> DataFrame:
    return index.postings.where(F.col("term") == term)


def next_geq(index: Index, probes: list[tuple[str, int]]) -> DataFrame:
    """term, k and the least doc_id >= k in the term's list, null if there is none. The probes go to the lists, not the lists to the probes."""
    asked = F.broadcast(index.postings.sparkSession.createDataFrame(probes, "term string, k long").distinct())
    lists = index.postings.where(F.col("term").isin(*{t for t, _ in probes})).select("term", "doc_id")
    least = lists.join(asked, "term").where("doc_id >= k").groupBy("term", "k").agg(F.min("doc_id").alias("doc_id"))
    return asked.join(least, ["term", "k"], "left")


class Held:
    """A list that is kept while it is in use: opened once, cleared or closed when it is done with."""

    def __init__(self, index: Index, term: str):
        self.term = term
        self._rows: DataFrame | None = load_all(index, term).persist()

    @property
    def rows(self) -> DataFrame:
        if self._rows is None:
            raise ValueError(f"the list of {self.term!r} is closed")
        return self._rows

    def clear(self) -> None:
        """Gives up what executors hold; the next use reads it again."""
        self.rows.unpersist()

    def close(self) -> None:
        self.clear()
        self._rows = None


def get_freq(index: Index, probes: list[tuple[str, int]]) -> DataFrame:
    """term, doc_id and tf, null if the list lacks the document."""
    asked = index.postings.sparkSession.createDataFrame(probes, "term string, doc_id long")
    lists = index.postings.where(F.col("term").isin(*{t for t, _ in probes}) & F.col("doc_id").isin(*{d for _, d in probes}))
    return asked.join(lists, ["term", "doc_id"], "left").select("term", "doc_id", "tf")
