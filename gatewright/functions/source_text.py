"""Line-level functions on source text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(files: DataFrame) -> DataFrame:
    """(file_idx, line_no, text) of all lines, numbered from 1 and ended by line feeds only, as in the lexer; null text has none."""
    parts = F.posexplode(F.split("text", "\n"))
    return files.select("file_idx", parts.alias("at", "text")).select("file_idx", (F.col("at") + 1).alias("line_no"), "text")


def pragma_cases(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """case keywords right below a line with full_case or parallel_case: the join form of the `pragma` column."""
    tokens = nodes.where("is_token AND kind IN ('CaseKeyword', 'CaseXKeyword', 'CaseZKeyword')").select("file_idx", "file", "line", "col", "kind")
    above = lines(files).select("file_idx", (F.col("line_no") + 1).alias("line"), F.lower("text").alias("t")).where("contains(t, 'full_case') OR contains(t, 'parallel_case')")
    return tokens.join(above.select("file_idx", "line"), ["file_idx", "line"], "left_semi")
