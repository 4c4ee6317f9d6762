"""Numbers along long lists without a window over a whole list.

Rows are sorted over ranges of (term, order), so a frequent term is split over
several tasks. Each task numbers its own rows of a term; what rows of the same
term came before in other ranges is one row a range at most, and is added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from corpusmith.functions.shared import written
from corpusmith.functions.ship import map_arrow


class Number:
    """Of rows sorted by (term, order): part, k (from 1 in the part's rows of the term), prev (the order before, null at first), edge (whether
    the row is the part's first or last) and, with value, total (the sum of it so far)."""

    def __init__(self, order: str, value: str | None = None):
        self.order, self.value = order, value

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = True, None
        for b in self.numbered(batches):
            if held is not None:
                yield self.edged(held, first, False)
                first = False
            held = b
        if held is not None:
            yield self.edged(held, first, True)

    @staticmethod
    def edged(b: pa.RecordBatch, first: bool, last: bool) -> pa.RecordBatch:
        edge = np.zeros(b.num_rows, bool)
        edge[0] |= first
        edge[-1] |= last
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(edge)], [*b.schema.names, "edge"])

    def numbered(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, k0, prev0, sum0 = None, 0, 0, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            term, order = b.column("term"), b.column(self.order).to_numpy(zero_copy_only=False)
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(term.slice(1), term.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            goes_on = last is not None and term[0].as_py() == last
            new[0] = not goes_on
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, 0))
            head = start == 0 if goes_on else np.zeros(n, bool)
            head &= np.cumsum(new) == 0
            k = at - start + 1 + np.where(head, k0, 0)
            prev = np.r_[prev0, order[:-1]]
            columns = [*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(k.astype(np.int64)), pa.array(prev.astype(np.int64), mask=new)]
            names = [*b.schema.names, "part", "k", "prev"]
            if self.value is not None:
                value = np.cumsum(b.column(self.value).to_numpy(zero_copy_only=False))
                total = value - np.where(start > 0, value[start - 1], 0) + np.where(head, sum0, 0)
                columns.append(pa.array(total.astype(np.int64)))
                names.append("total")
                sum0 = int(total[-1])
            last, k0, prev0 = term[n - 1].as_py(), int(k[-1]), int(order[-1])
            yield pa.RecordBatch.from_arrays(columns, names)


def schema_of(rows: DataFrame, value: str | None = None) -> StructType:
    out = StructType([*rows.schema.fields]).add("part", IntegerType()).add("k", LongType()).add("prev", LongType())
    return (out if value is None else out.add("total", LongType())).add("edge", BooleanType())


def ranged(rows: DataFrame, order: str, value: str | None = None) -> DataFrame:
    """rows in ranges of (term, order), each numbered within its range."""
    by = ["term", order]
    return map_arrow(rows.repartitionByRange(*by).sortWithinPartitions(*by), Number(order, value), schema_of(rows, value))


def spans(numbered: DataFrame, order: str, value: str | None = None) -> DataFrame:
    """part, term, before, last and sum_before of each range that begins with a term that ranges before it hold: as many rows as ranges at most."""
    total = F.lit(0).cast("long") if value is None else F.col("total")
    ends: dict[int, list] = {}
    for r in numbered.where("edge").select("part", "term", "k", F.col(order).alias("at"), total.alias("total")).collect():
        ends.setdefault(r["part"], []).append(r)
    out, term, n, at, sum_ = [], None, 0, 0, 0
    for part in sorted(ends):
        # A part of one row has one edge; of two edges of a term the later has the greater k.
        rows = ends[part]
        if len(rows) == 2 and rows[0]["term"] == rows[1]["term"]:
            rows.sort(key=lambda r: r["k"])
        elif len(rows) == 2 and rows[0]["term"].encode() > rows[1]["term"].encode():
            rows.reverse()
        begin, end = rows[0], rows[-1]
        goes_on = term is not None and begin["term"] == term
        if goes_on:
            out.append((part, term, n, at, sum_))
        whole = goes_on and end["term"] == term
        n, sum_ = end["k"] + (n if whole else 0), end["total"] + (sum_ if whole else 0)
        term, at = end["term"], end["at"]
    return numbered.sparkSession.createDataFrame(out, "part int, term string, before long, last long, sum_before long")


def placed(numbered: DataFrame, span: DataFrame) -> DataFrame:
    """Rows with k, prev and total as of the whole list."""
    out = numbered.join(F.broadcast(span), ["part", "term"], "left").withColumns({"k": F.col("k") + F.coalesce("before", F.lit(0)), "prev": F.coalesce("prev", "last")})
    if "total" in numbered.columns:
        out = out.withColumn("total", F.col("total") + F.coalesce("sum_before", F.lit(0)))
    return out.drop("part", "edge", "before", "last", "sum_before")


def numbered(rows: DataFrame, order: str, value: str | None = None) -> DataFrame:
    """rows with k, prev and, with value, total along each term's list. The ranges are written; drop_written of the result drops them."""
    held = written(ranged(rows, order, value), "ranges")
    out = placed(held, spans(held, order, value))
    out.shared_path = held.shared_path
    return out
