"""Intermediate tables in the folder that all executors share.

Tables are deleted by `discard` as soon as nothing reads them any more, and what is
left when the driver's Python ends is deleted then.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.  Where it is unset, a temporary folder in local mode (tests), else an error:
    the executors of a cluster would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: set it to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gatewright-")
        spark.conf.set("spark.checkpoint.dir", found)
        _left[found] = spark
    return found.rstrip("/")


#: Rows of a narrow table for each file, where their number is known.
FILE_ROWS = 1 << 14


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    `rows` is about the number of rows, or a bound: a small narrow table is written by few tasks, FILE_ROWS each, instead of one
    nearly empty file for every shuffle partition.
    """
    if rows is not None:
        tasks = -(-rows // FILE_ROWS) or 1
        if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(tasks)
    path = f"{shared_folder(df.sparkSession)}/gatewright-{uuid.uuid4().hex}"
    _left[path] = df.sparkSession
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._gatewright_path = path
    return out


def _delete(path: str, spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables made by `written`; no DataFrame that reads them may be used afterwards."""
    for table in tables:
        path = getattr(table, "_gatewright_path", None)
        if path in _left:
            _delete(path, _left.pop(path))


def release(spark: SparkSession) -> None:
    """Frees what finished queries leave behind.  Spark deletes their shuffle files and broadcasts only when the driver's JVM has
    collected the objects that stand for them; between the rounds of a loop that would come late, with a larger heap by then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _clear() -> None:
    for path, spark in list(_left.items()):
        try:
            _delete(path, spark)
        except Exception:  # noqa: BLE001 - the session has ended and its file systems with it
            pass
        _left.pop(path, None)
