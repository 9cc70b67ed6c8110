"""Order-dependent symbol resolution in closed form: three aggregates and two joins, no iteration.

A symbol is born in a scope at its first declaration there, or at its first use there
if no global symbol of the name exists yet by then.  A use binds to the local
symbol if that is born by the time of the use, else to the global one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.facts import GLOBAL


def bind(events: DataFrame) -> DataFrame:
    """Events with `bound_scope` (the scope of the symbol they belong to)."""
    is_use = F.col("ev") == "use"
    per = events.groupBy("scope_id", "name").agg(F.min(F.when(~is_use, F.col("seq"))).alias("fd"), F.min(F.when(is_use, F.col("seq"))).alias("fu"))
    g = per.where(F.col("scope_id") == GLOBAL).select("name", F.least("fd", "fu").alias("g"))
    born = per.join(g, "name", "left").select(
        "scope_id",
        "name",
        F.least("fd", F.when((F.col("scope_id") == GLOBAL) | F.col("g").isNull() | (F.col("fu") < F.col("g")), F.col("fu"))).alias("birth"),
    )
    local = events.join(born, ["scope_id", "name"])
    here = (F.col("ev") == "decl") | (F.col("birth") <= F.col("seq"))
    return local.withColumn("bound_scope", F.when(here, F.col("scope_id")).otherwise(F.lit(GLOBAL))).drop("birth")


def symbols(bound: DataFrame) -> DataFrame:
    """One row per symbol with its merged flags, first places and counts."""
    is_decl, is_use = F.col("ev") == "decl", F.col("ev") == "use"
    place = F.struct("seq", "line", "col", "file")
    s = bound.groupBy(F.col("bound_scope").alias("scope_id"), "name").agg(
        F.max_by("decl_kind", F.when(is_decl, F.col("seq"))).alias("last_kind"),
        F.bool_or("is_port").alias("is_port"),
        F.bool_or(is_use & F.col("read")).alias("is_read"),
        F.bool_or(is_use & F.col("write")).alias("is_written"),
        F.min("seq").alias("birth_seq"),
        F.min_by("nettype_none", "seq").alias("born_none"),
        F.min(F.when(is_decl, place)).alias("first_decl"),
        F.min(F.when(is_use, place)).alias("first_use"),
        F.count(F.when(is_decl, 1)).alias("n_decl"),
        F.count(F.when(is_use, 1)).alias("n_use"),
        F.min(F.when(is_use & F.col("read"), place)).alias("first_read"),
        F.min(F.when(is_use & F.col("write"), F.col("seq"))).alias("first_write"),
    )
    implicit = (F.col("n_decl") == 0) & ~F.col("born_none")
    kind = F.when(F.col("n_decl") > 0, F.col("last_kind")).when(F.col("born_none"), F.lit("variable")).otherwise(F.lit("implicit_net"))
    return s.withColumn("kind", kind).withColumn("is_implicit", implicit).drop("last_kind", "born_none")


def lookup_from_scope(symbols: DataFrame, asked: DataFrame) -> DataFrame:
    """(scope_id, name) -> the scope of the nearest symbol, null if none: local first, then global."""
    local = symbols.select("scope_id", "name", F.col("scope_id").alias("own"))
    top = symbols.where(F.col("scope_id") == GLOBAL).select("name", F.lit(GLOBAL).alias("top"))
    return asked.join(local, ["scope_id", "name"], "left").join(top, "name", "left").select("scope_id", "name", F.coalesce("own", "top").alias("found_scope"))


def lookup_qualified(scopes: DataFrame, symbols: DataFrame, asked: DataFrame) -> DataFrame:
    """(module, name) paths from the global scope: the first module of the name, then its symbol; found_scope is null if either is missing."""
    first = scopes.groupBy(F.col("name").alias("module")).agg(F.min_by("scope_id", F.struct("file_idx", "pre")).alias("scope_id"))
    own = symbols.select("scope_id", "name", F.lit(True).alias("hit"))
    return asked.join(first, "module", "left").join(own, ["scope_id", "name"], "left").select("module", "name", F.when(F.col("hit"), F.col("scope_id")).alias("found_scope"))


def lookup_global(symbols: DataFrame, scopes: DataFrame, asked: DataFrame) -> DataFrame:
    """(name) -> first scope, in depth-first order of the scope tree, that has the symbol."""
    order = scopes.select("scope_id", F.struct(F.lit(1).alias("d"), "file_idx", "pre").alias("o"))
    ranked = symbols.join(order, "scope_id", "left").withColumn("o", F.coalesce("o", F.struct(F.lit(0).alias("d"), F.lit(0).alias("file_idx"), F.lit(0).alias("pre"))))
    first = ranked.groupBy("name").agg(F.min_by("scope_id", "o").alias("found_scope"))
    return asked.join(first, "name", "left").select("name", "found_scope")
