"""The 7 symbol rules over symbols and bound events; order is registration order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _at(rows: DataFrame, place: str, message) -> DataFrame:
    """Diagnostics at a place struct (seq, line, col, file)."""
    return rows.select("scope_id", "name", "birth_seq", F.col(f"{place}.seq").alias("seq"), F.col(f"{place}.line").alias("line"), F.col(f"{place}.col").alias("col"), message.alias("message"), F.col(f"{place}.file").alias("file"))


def unused_variable(symbols: DataFrame, bound: DataFrame) -> DataFrame:
    return _at(symbols.where("kind = 'variable' AND n_use = 0 AND n_decl > 0"), "first_decl", F.format_string("Unused variable '%s'", "name"))


def undeclared_variable(symbols: DataFrame, bound: DataFrame) -> DataFrame:
    return _at(symbols.where("NOT is_implicit AND n_use > 0 AND n_decl = 0"), "first_use", F.format_string("Undeclared variable '%s'", "name"))


def no_implicit_net(symbols: DataFrame, bound: DataFrame) -> DataFrame:
    return _at(symbols.where("is_implicit AND kind = 'implicit_net' AND n_use > 0"), "first_use", F.format_string("Implicit net '%s' is not allowed", "name"))


def no_multiple_drivers(symbols: DataFrame, bound: DataFrame) -> DataFrame:
    """At the first write of the second distinct driver, in order of the drivers' first writes."""
    key = [F.col("bound_scope").alias("scope_id"), "name"]
    drives = bound.where("ev = 'use' AND write AND driver_id IS NOT NULL")
    first = drives.groupBy(*key, "driver_id").agg(F.min(F.struct("seq", "line", "col", "file", "driver_line")).alias("p"))
    # the least two places by a fold that carries two, however many drivers there are
    lead = first.groupBy("scope_id", "name").agg(F.min("p").alias("lead"))
    rest = first.join(lead, ["scope_id", "name"]).where("p.seq > lead.seq").groupBy("scope_id", "name").agg(F.min("p").alias("place"), F.first("lead").alias("lead"))
    declared = symbols.where("kind = 'variable' AND n_decl > 0").select("scope_id", "name", "birth_seq")
    return _at(rest.join(declared, ["scope_id", "name"]), "place", F.format_string("Variable '%s' is written from multiple procedural blocks (first driver at line %d)", "name", F.col("lead.driver_line")))


def no_undriven_signal(symbols: DataFrame, bound: DataFrame) -> DataFrame:
    return _at(symbols.where("kind = 'variable' AND n_decl > 0 AND NOT is_port AND is_read AND NOT is_written"), "first_decl", F.format_string("Signal '%s' is read but never driven", "name"))


def redeclared_variable(symbols: DataFrame, bound: DataFrame) -> DataFrame:
    """One row per declaration after the first, of any kind."""
    decls = bound.where("ev = 'decl'").select(F.col("bound_scope").alias("scope_id"), "name", F.struct("seq", "line", "col", "file").alias("place"))
    # the symbol has its first declaration already, so no name is sorted in one task
    known = symbols.where("n_decl > 1").select("scope_id", "name", "birth_seq", "first_decl")
    rows = decls.join(known, ["scope_id", "name"]).where("place.seq > first_decl.seq")
    return _at(rows, "place", F.format_string("Redeclared symbol '%s' (first declared at line %d)", "name", F.col("first_decl.line")))


def read_before_write(symbols: DataFrame, bound: DataFrame) -> DataFrame:
    early = symbols.where("kind = 'variable' AND n_decl > 0 AND first_read IS NOT NULL").where(F.col("first_write").isNull() | (F.col("first_read.seq") <= F.col("first_write")))
    return _at(early, "first_read", F.format_string("Variable '%s' read before write", "name"))


RULES: list[tuple[str, Callable[[DataFrame, DataFrame], DataFrame]]] = [
    ("UNUSED_VARIABLE", unused_variable),
    ("UNDECLARED_VARIABLE", undeclared_variable),
    ("NO_IMPLICIT_NET", no_implicit_net),
    ("NO_MULTIPLE_DRIVERS", no_multiple_drivers),
    ("NO_UNDRIVEN_SIGNAL", no_undriven_signal),
    ("REDECLARED_VARIABLE", redeclared_variable),
    ("READ_BEFORE_WRITE", read_before_write),
]


def symbol_diagnostics(symbols: DataFrame, bound: DataFrame) -> DataFrame:
    out = None
    for i, (code, rule) in enumerate(RULES):
        rows = rule(symbols, bound).select(F.lit(i).alias("ord"), F.lit(code).alias("code"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out
