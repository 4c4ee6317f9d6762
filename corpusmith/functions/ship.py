"""Sends this package to the executors, so that functions defined in it run there."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: adds a zip of the package to what Python workers import from."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    root = Path(__file__).resolve().parent.parent
    out = os.path.join(tempfile.mkdtemp(prefix="corpusmith-"), f"{root.name}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(out)
    _SENT.add(sc.applicationId)


class _Trimmed:
    """A function over batches that gives its freed memory back to the system, as Python workers outlive their tasks."""

    def __init__(self, function):
        self.function = function

    def __call__(self, batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from self.function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # only glibc has it
                pass


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow with a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(_Trimmed(function), schema)
