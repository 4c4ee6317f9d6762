"""Tables of rows in blocks, to which decisions go back without a shuffle of the rows.

``stored`` writes rows once, each with a uid whose high bits name the block (the
task that wrote it). What later steps find out about rows is ids and numbers; it
is shuffled by block and written to a folder of its own for each, sorted by uid.
A task that reads rows of a block reads that folder beside them, so texts stay
where they are, whatever the size of either side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.functions.shared import new_path, written

#: A uid is its block times this, and the row's number in the block.
_ROWS = 33


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows with a uid. Written."""
    return written(rows.withColumn("uid", F.monotonically_increasing_id()), name)


def send(side: DataFrame, name: str) -> str:
    """The path of side's rows (uid and other columns), by block and sorted by all columns. The caller deletes it."""
    path = new_path(side.sparkSession, name)
    by = side.withColumn("block", F.shiftright("uid", _ROWS)).repartition("block").sortWithinPartitions("block", *side.columns)
    by.write.partitionBy("block").option("compression", "zstd").parquet(path)
    return path


def release(spark: SparkSession) -> None:
    """Has shuffle files deleted that no plan uses any more; they go when the driver collects what names them."""
    spark.sparkContext._jvm.System.gc()


class Side:
    """What was sent to path, in a task: the columns of the block that is being read."""

    def __init__(self, path: str, *columns: str):
        self.path, self.columns = path, ("uid", *columns)
        self._block, self._held = -1, []

    def _of(self, block: int) -> list[np.ndarray]:
        if block != self._block:
            fs, inner = pafs.FileSystem.from_uri(self.path)
            folder = f"{inner}/block={block}"
            if fs.get_file_info(folder).type == pafs.FileType.NotFound:
                self._held = [np.zeros(0, np.int64) for _ in self.columns]
            else:
                table = pq.read_table(folder, columns=list(self.columns), filesystem=fs, partitioning=None).sort_by([(c, "ascending") for c in self.columns])
                self._held = [table.column(c).to_numpy() for c in self.columns]
            self._block = block
        return self._held

    def cut(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[np.ndarray]]]:
        """The batch, block by block: its rows, at[0][i] : at[1][i] as the places of row i's in the columns, and the columns."""
        uid = batch.column("uid").to_numpy()
        ends = np.r_[np.flatnonzero(np.diff(uid >> _ROWS)) + 1, len(uid)]
        lo = 0
        for hi in ends.tolist():
            if hi > lo:
                side = self._of(int(uid[lo]) >> _ROWS)
                yield batch.slice(lo, hi - lo), np.stack([np.searchsorted(side[0], uid[lo:hi], s) for s in ("left", "right")]), side[1:]
            lo = hi
