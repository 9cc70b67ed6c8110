"""The full lint: one lazy plan from files to ordered diagnostics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import module_rules, resolution, symbol_rules, syntax_rules
from ..sources.files import included, read_files
from ..sources.nodes import parse_files
from . import facts

#: What the full lint reads of the node table.
COLUMNS = sorted({*syntax_rules.COLUMNS, *facts.COLUMNS})
KINDS = syntax_rules.KINDS | facts.KINDS
#: Sort key of the result: phase 1 syntax (file, node, rule), 2 symbols (rule, scope, birth, place), 3 modules.
KEYS = ["phase", "k1", "k2", "k3", "k4", "k5"]


@dataclass
class Facts:
    nodes: DataFrame
    scopes: DataFrame
    refs: DataFrame
    bound: DataFrame
    symbols: DataFrame

    def release(self) -> None:
        for kept in (self.symbols, self.bound, self.nodes):
            kept.unpersist()


def derive(nodes: DataFrame) -> Facts:
    """Facts for all rules.  Parsing, binding and the symbol table feed many rules each, so they are kept
    instead of being computed once per rule; lost blocks are recomputed by lineage.  They are kept on disk: at 900,000 files,
    blocks in memory exhausted the heap (probably as G1 takes two regions for each of their arrays of 1 MB).
    The hint is that of `parse_files`; it does not pass through the joins of binding, so it is given again."""
    nodes = nodes.hint("merge").persist(StorageLevel.DISK_ONLY)
    bound = resolution.bind(facts.events(nodes)).hint("merge").persist(StorageLevel.DISK_ONLY)
    symbols = resolution.symbols(bound).persist(StorageLevel.DISK_ONLY)
    return Facts(nodes, facts.scopes(nodes), facts.module_refs(nodes), bound, symbols)


def _keyed(rows: DataFrame, phase: int, *keys) -> DataFrame:
    keys = [*keys, *[F.lit("")] * (5 - len(keys))]
    return rows.select(F.lit(phase).alias("phase"), *[k.cast("string").alias(f"k{i + 1}") for i, k in enumerate(keys)], "code", F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"), "message", "file")


def _n(c):
    return F.format_string("%010d", c)


def _seq_key(s: str):
    return F.concat_ws(":", *[F.format_string("%010d", F.col(f"{s}.{p}")) for p in ("file_idx", "pre", "sub")])


def diagnostics(f: Facts, extra: tuple = ()) -> DataFrame:
    """All diagnostics with their sort keys; sort by KEYS for the result's order."""
    s = syntax_rules.syntax_diagnostics(f.nodes, extra)
    out = _keyed(s, 1, _n("file_idx"), _n("pre"), _n("ord"))
    y = symbol_rules.symbol_diagnostics(f.symbols, f.bound)
    scope = F.when(F.col("scope_id") == facts.GLOBAL, F.lit("")).otherwise(F.col("scope_id"))
    out = out.unionByName(_keyed(y, 2, _n("ord"), scope, _seq_key("birth_seq"), F.col("name"), _seq_key("seq")))
    d = module_rules.duplicate_module(f.scopes).withColumn("code", F.lit("DUPLICATE_MODULE"))
    out = out.unionByName(_keyed(d, 3, F.lit("0"), _n("group_seq.first_file_idx"), _n("group_seq.first_pre"), _n("own_seq.file_idx"), _n("own_seq.pre")))
    u = module_rules.undefined_module(f.refs, f.scopes).withColumn("code", F.lit("UNDEFINED_MODULE"))
    return out.unionByName(_keyed(u, 3, F.lit("1"), _seq_key("seq")))


def formatted(diags: DataFrame) -> DataFrame:
    """`{file}:{line}:{col} - [{code}] {message}`; no prefix without a file."""
    prefix = F.when(F.col("file").isNull() | (F.col("file") == ""), F.lit("")).otherwise(F.concat("file", F.lit(":")))
    return diags.withColumn("text", F.concat(prefix, F.format_string("%d:%d - [%s] %s", "line", "col", "code", "message")))


def lint_nodes(nodes: DataFrame, extra: tuple = ()) -> DataFrame:
    return diagnostics(derive(nodes), extra)


def lint(spark: SparkSession, paths: list, jobs: int = 1, extra: tuple = (), include_dirs: tuple = ()) -> DataFrame:
    """Diagnostics of files, unsorted; jobs is the number of parse partitions.

    `extra` are further syntax rules (code, message, SQL predicate on a node row), registered behind the built-in ones.
    """
    if jobs < 1:
        raise ValueError(f"jobs must be >= 1, got {jobs}")
    files = read_files(spark, paths)
    files = files.repartition(jobs) if jobs > 1 else files
    headers = included(spark, files, include_dirs)
    nodes = parse_files(files, None, None, headers, include_dirs) if extra else parse_files(files, COLUMNS, KINDS, headers, include_dirs)
    return lint_nodes(nodes, extra)
