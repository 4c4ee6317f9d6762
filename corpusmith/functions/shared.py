"""Tables that cut lineage: Parquet in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side of a join is sent to every executor; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local-mode session without one gets a folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="corpusmith-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{re.sub(r'[^A-Za-z0-9_]', '_', name)}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: no lineage, and safe when executors are lost."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_written(*tables: DataFrame) -> None:
    """Deletes what the tables lie in: shared_path, one path or several."""
    for df in tables:
        paths = getattr(df, "shared_path", ())
        for path in (paths,) if isinstance(paths, str) else paths:
            delete(df.sparkSession, path)


#: What a row takes in a broadcast hash table beside its own bytes: header, null bits, pointers and slots, measured at some 120 bytes.
ROW_OVERHEAD = 120


def small_enough(table: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a written table, by its counted rows, may be sent to every executor."""
    return table.count() * (row_bytes + ROW_OVERHEAD) <= limit


def checked_broadcast(table: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The table, marked for broadcast if its counted size allows; else as it is, for a shuffled join."""
    return F.broadcast(table) if small_enough(table, row_bytes, limit) else table
