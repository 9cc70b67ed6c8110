"""Registered queries of the code-analytics part, one per operator, over the bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.source_text import pragma_cases
from ..operators import containment, module_rules, resolution, symbol_rules, syntax_rules
from ..sources.files import nettype_none
from . import bridges, facts
from .lint import COLUMNS, KINDS, formatted, lint_nodes


_IDENTIFIERS = frozenset({"IdentifierName", "IdentifierSelectName"})


def _syntax(code: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return syntax_rules.rule(bridges.text_nodes(spark, sf_dir, syntax_rules.columns_of(code), syntax_rules.KINDS), code).select("file", "line", "col", "message")

    return run


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bound = resolution.bind(bridges.fact_events(spark, sf_dir))
    return resolution.symbols(bound), bound


def _symbol(rule):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rule(*_facts(spark, sf_dir)).select("scope_id", "name", "line", "col", "message")

    return run


def syntax_all(spark, sf_dir):
    """The fused scan of all syntax rules with each file's own order."""
    d = syntax_rules.syntax_diagnostics(bridges.text_nodes(spark, sf_dir, syntax_rules.COLUMNS, syntax_rules.KINDS))
    order = W.partitionBy("file_idx").orderBy("pre", "ord")
    return d.select("file", F.row_number().over(order).cast("bigint").alias("pos"), "code", "line", "col")


def symbol_resolution(spark, sf_dir):
    bound = resolution.bind(bridges.fact_events(spark, sf_dir))
    return bound.select(F.col("seq.pre").cast("bigint").alias("event_id"), "scope_id", "name", "ev", "bound_scope")


def symbol_table(spark, sf_dir):
    s, _ = _facts(spark, sf_dir)
    return s.select("scope_id", "name", "kind", "is_implicit", "is_port", "is_read", "is_written", F.col("birth_seq.pre").cast("bigint").alias("birth"), F.col("first_decl.seq.pre").cast("bigint").alias("first_decl"), F.col("first_use.seq.pre").cast("bigint").alias("first_use"), "n_decl", "n_use")


def module_duplicates(spark, sf_dir):
    return module_rules.duplicate_module(bridges.fact_scopes(spark, sf_dir)).select("name", "file", "line", "message")


def module_undefined_refs(spark, sf_dir):
    return module_rules.undefined_module(bridges.fact_refs(spark, sf_dir), bridges.fact_scopes(spark, sf_dir)).select("name", "line", "col", "message")


def module_registry(spark, sf_dir):
    return module_rules.registry(bridges.fact_scopes(spark, sf_dir))


def lookup_from_scope(spark, sf_dir):
    """Every (user, name) of the events, asked from the user's scope."""
    s, _ = _facts(spark, sf_dir)
    asked = bridges.fact_events(spark, sf_dir).select("scope_id", "name").distinct()
    return resolution.lookup_from_scope(s, asked)


def _asked_modules(spark, sf_dir):
    """Symbols s0.. of the modules: each scope c<key> holds s<key % 40>; every order asks for one path."""
    scopes = bridges.fact_scopes(spark, sf_dir)
    symbols = scopes.select("scope_id", F.concat(F.lit("s"), (F.col("pre") % bridges.NAMES).cast("string")).alias("name"))
    orders = bridges.table(spark, sf_dir, "orders")
    asked = orders.select(F.concat(F.lit("m"), (F.col("o_custkey") % 60).cast("string")).alias("module"), F.concat(F.lit("s"), (F.col("o_orderkey") % bridges.NAMES).cast("string")).alias("name")).distinct()
    return scopes, symbols, asked


def lookup_module_path(spark, sf_dir):
    return resolution.lookup_qualified(*_asked_modules(spark, sf_dir))


def lookup_module_name(spark, sf_dir):
    scopes, symbols, asked = _asked_modules(spark, sf_dir)
    return resolution.lookup_global(symbols, scopes, asked.select("name").distinct())


def access_mode(spark, sf_dir):
    n = bridges.text_nodes(spark, sf_dir, containment.COLUMNS)
    files = bridges.text_files(spark, sf_dir).select("file_idx", F.col("path").alias("file"))
    return containment.access_mode(n).join(files, "file_idx").select("file", "line", "col", "name", "read", "write")


def access_mode_inherited(spark, sf_dir):
    """The same from the columns that the walk computes."""
    n = bridges.text_nodes(spark, sf_dir, ["file", "line", "col", "name", "read", "write"], _IDENTIFIERS).where("name IS NOT NULL")
    return n.select("file", "line", "col", "name", "read", "write")


def driver_id(spark, sf_dir):
    n = bridges.text_nodes(spark, sf_dir, ["file", "line", "col", "name", "write", "proc_kind", "proc_line", "proc_col"], _IDENTIFIERS).where("name IS NOT NULL AND write")
    return n.select("file", "line", "col", "name", facts.driver_id().alias("driver_id"))


def nearest_ancestor(spark, sf_dir):
    """Innermost process of every identifier that has one."""
    n = bridges.text_nodes(spark, sf_dir, containment.COLUMNS)
    files = bridges.text_files(spark, sf_dir).select("file_idx", F.col("path").alias("file"))
    found = containment.nearest_ancestor(n, F.col("cls").isin("IdentifierName", "IdentifierSelectName"), F.col("cls") == "ProceduralBlock")
    return found.join(files, "file_idx").select("file", "line", "col", "anc_kind", "anc_line")


def nettype_none_files(spark, sf_dir):
    return bridges.text_files(spark, sf_dir).select(F.col("path").alias("file"), nettype_none(F.col("text")).alias("nettype_none"))


def pragma_line_join(spark, sf_dir):
    found = pragma_cases(bridges.text_nodes(spark, sf_dir, ["file_idx", "file", "line", "col", "kind", "is_token"], frozenset({"CaseKeyword", "CaseXKeyword", "CaseZKeyword"})), bridges.text_files(spark, sf_dir))
    return found.select("file", "line", "col", "kind")


def node_counts(spark, sf_dir):
    """Nodes of each token kind per file: the lexer's and parser's output."""
    n = bridges.text_nodes(spark, sf_dir, ["file", "kind"], frozenset({"Equals", "LessThanEquals", "Semicolon", "BeginKeyword", "EndKeyword"}))
    return n.groupBy("file", "kind").agg(F.count("*").alias("n"))


def module_references(spark, sf_dir):
    return facts.module_refs(bridges.text_nodes(spark, sf_dir, facts.COLUMNS, frozenset({"HierarchyInstantiation"}))).select("name", "file", "line", "col")


def module_scopes(spark, sf_dir):
    return facts.scopes(bridges.text_nodes(spark, sf_dir, facts.COLUMNS, frozenset({"ModuleDeclaration"}))).select("name", "file", "line", "col", "parent_id")


def diagnostics_formatted(spark, sf_dir):
    """The full lint as text lines."""
    return formatted(lint_nodes(bridges.text_nodes(spark, sf_dir, COLUMNS, KINDS))).select("text")


def diagnostics_summary(spark, sf_dir):
    return lint_nodes(bridges.text_nodes(spark, sf_dir, COLUMNS, KINDS)).groupBy("code").agg(F.count("*").alias("n"))


def queries() -> dict:
    out = {f"syntax_{code.lower()}": _syntax(code) for code, _, _ in syntax_rules.RULES}
    out |= {f"symbol_{code.lower()}": _symbol(rule) for code, rule in symbol_rules.RULES}
    for f in (syntax_all, symbol_resolution, symbol_table, module_duplicates, module_undefined_refs, module_registry, lookup_from_scope, lookup_module_path, lookup_module_name, access_mode, access_mode_inherited, driver_id, nearest_ancestor, nettype_none_files, pragma_line_join, node_counts, module_references, module_scopes, diagnostics_formatted, diagnostics_summary):
        out[f.__name__] = f
    return out
