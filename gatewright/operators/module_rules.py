"""The 2 module rules, across all files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_module(scopes: DataFrame) -> DataFrame:
    """Each definition after the first of its name (columns file_idx and pre give the order)."""
    own = F.struct("file_idx", "pre", "file")
    first = scopes.groupBy("name").agg(F.min(own).alias("lead"), F.count("*").alias("n")).where("n > 1")
    rows = scopes.join(first, "name").where(F.struct("file_idx", "pre") > F.struct("lead.file_idx", "lead.pre"))
    message = F.format_string("Duplicate module '%s' (first defined in %s)", "name", F.coalesce("lead.file", F.lit("None")))
    return rows.select("name", F.struct(F.col("lead.file_idx").alias("first_file_idx"), F.col("lead.pre").alias("first_pre")).alias("group_seq"), F.struct("file_idx", "pre").alias("own_seq"), "line", "col", message.alias("message"), "file")


def undefined_module(refs: DataFrame, scopes: DataFrame) -> DataFrame:
    """One row per reference to a name that no file defines."""
    missing = refs.join(scopes.select("name").distinct(), "name", "left_anti")
    return missing.select("name", "seq", "line", "col", F.format_string("Instantiation of undefined module '%s'", "name").alias("message"), "file")


def registry(scopes: DataFrame) -> DataFrame:
    """Definitions per module name."""
    return scopes.groupBy("name").agg(F.count("*").alias("n_definitions"))


RULES = ["DUPLICATE_MODULE", "UNDEFINED_MODULE"]
