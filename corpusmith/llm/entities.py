"""What the deduplicating operators mean by a document, and how their decisions go back to its rows.

A document is a pair (doc_id, text): did is the doc_id, or the least long for
null; th is a 64-bit hash of the text. Rows that agree in both are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_ID = -(1 << 63)
KEY = ("did", "th")


def did(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(NO_ID))


def th(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """did, th and text (a null text as an empty one) of each row; no other column, so none can clash."""
    return docs.select(did(docs["doc_id"]).alias("did"), th(docs["text"]).alias("th"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def doc_id() -> Column:
    return F.when(F.col("did") != NO_ID, F.col("did")).alias("doc_id")


def packed(docs: DataFrame) -> DataFrame:
    """did, th and the whole row as a struct, for joins that must not see the row's own names."""
    return docs.select(did(docs["doc_id"]).alias("did"), th(docs["text"]).alias("th"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
