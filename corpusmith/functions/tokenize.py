"""Tokenisers as column expressions. Two delimiter sets: the index splits on more signs than the query does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMMON = r""" ,.;:?\[\]{}()\-/+*&^"'"""
INDEX_REGEX = "[" + _COMMON + r"@!#%><|~" + "\\n" + "，。（）·～？》《｜、；：「」【】“’" + "]+"
QUERY_REGEX = "[" + _COMMON + "\\n" + "]+"
#: One delimiter of the query set, for offsets.
QUERY_ONE = QUERY_REGEX[:-1]


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def index_terms(text: Column | str) -> Column:
    """Terms of a document in order, with repeats."""
    return F.array_remove(F.split(_column(text), INDEX_REGEX), "")


def query_terms(text: Column | str) -> Column:
    """Distinct terms of a query, sorted."""
    return F.array_sort(F.array_distinct(F.array_remove(F.split(_column(text), QUERY_REGEX), "")))


def query_words(query: str) -> list[str]:
    """The same for a query held by the driver."""
    import re

    return sorted({w for w in re.split(QUERY_REGEX, query) if w})


def sql_list(text: str, regex: str) -> str:
    """Terms of a text as a DuckDB list."""
    quoted = regex.replace("'", "''")
    return f"list_filter(regexp_split_to_array({text}, '{quoted}'), lambda w: w <> '')"
