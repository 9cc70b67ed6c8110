"""Syntax rules over a folder that receives files.

Symbol and module rules need all files in order, so only the rules that look at one
file run in micro-batches; each file is parsed once, when it arrives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.syntax_rules import COLUMNS, KINDS, syntax_diagnostics
from ..sources.nodes import parse_files


def watch(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None], once: bool = False) -> StreamingQuery:
    """Call `sink(diagnostics, batch)` for the new .v and .sv files of each micro-batch."""
    stream = spark.readStream.option("wholetext", True).option("pathGlobFilter", "*.{v,sv}").option("recursiveFileLookup", True).text(folder, wholetext=True)
    files = stream.select(F.lit(0).alias("file_idx"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))

    def each(batch: DataFrame, number: int) -> None:
        # a file is one group of nodes: its index is its place among the paths of the batch, so no two files share one
        paths = batch.select("path").distinct().withColumn("part", F.spark_partition_id())
        paths = paths.persist()
        sizes = paths.groupBy("part").count().withColumn("before", F.sum("count").over(W.orderBy("part")) - F.col("count"))
        numbered = paths.join(F.broadcast(sizes), "part").select("path", (F.col("before") + F.row_number().over(W.partitionBy("part").orderBy("path")) - 1).cast("int").alias("file_idx"))
        nodes = parse_files(batch.drop("file_idx").join(numbered, "path"), COLUMNS, KINDS).persist()
        sink(syntax_diagnostics(nodes).select("file", "line", "col", "code", "message"), number)
        nodes.unpersist()
        paths.unpersist()

    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
