"""The 14 syntax rules as one fused scan.

Two of them look at a whole process; the walk marks their nodes (columns `mixed` and `latch`), as a process never
leaves its file.  `mixed_assignment_style` and `latch_in_always_comb` are the same as aggregates over node rows.
Order of RULES is registration order, the tie-break for several rules at one node.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.verilog_parser import ASSIGNMENT_KINDS

# Codes, messages and order of the rules.  The third entry is the SQL predicate on a node row.
RULES: list[tuple[str, str, str]] = [
    ("NO_BLOCKING_SEQUENTIAL", "Blocking assignment used in sequential logic", "kind = 'Equals' AND in_always"),
    ("NO_NONBLOCKING_COMBINATIONAL", "Non-blocking assignment used in combinational logic", "kind = 'LessThanEquals' AND in_comb"),
    ("DEFAULT_CASE", "Case statement missing default case", "kind = 'EndCaseKeyword' AND in_case_gen AND NOT in_default"),
    ("NO_CASEX_CASEZ", "Use of casex/casez can hide X/Z mismatches", "kind IN ('CaseXKeyword', 'CaseZKeyword')"),
    ("NO_MIXED_ASSIGNMENT_STYLE", "Mixed blocking and non-blocking assignments used in the same procedural block", "mixed"),
    ("NO_INITIAL_BLOCK", "Use of initial blocks can be unsafe in synthesizable RTL", "kind = 'InitialBlock'"),
    ("NO_FINAL_BLOCK", "Use of final blocks is usually not appropriate in synthesizable RTL", "kind = 'FinalBlock'"),
    ("NO_ALWAYS_LATCH", "Use of always_latch can hide unintended latch-oriented design choices", "kind = 'AlwaysLatchBlock'"),
    ("NO_CASE_GENERATE", "Use of case generate can make structural intent harder to follow", "kind = 'CaseGenerate'"),
    ("NO_FULL_PARALLEL_CASE", "Use of full_case / parallel_case pragmas can hide real case coverage issues", "kind IN ('CaseKeyword', 'CaseXKeyword', 'CaseZKeyword') AND pragma"),
    ("NO_UNIQUE_PRIORITY_CASE", "Use of unique/priority case can overstate case completeness or exclusivity", "kind IN ('UniqueKeyword', 'PriorityKeyword')"),
    ("NO_INOUT_INTERNAL", "Internal inout declarations are not allowed", "kind = 'PortDeclaration' AND direction = 'InOutKeyword'"),
    ("NO_LATCH_IN_ALWAYS_COMB", "always_comb block contains a conditional-only assignment that can infer latch-like storage", "kind = 'AlwaysCombBlock' AND latch"),
    ("NO_DEFPARAM", "Use of defparam is discouraged; prefer explicit parameter overrides at instantiation", "kind = 'DefParamKeyword'"),
]
#: What the rules read of the node table: columns, and the kinds of nodes that any of them looks at.
COLUMNS = ["file_idx", "file", "pre", "kind", "line", "col", "in_always", "in_comb", "in_case_gen", "in_default", "pragma", "direction", "mixed", "latch"]
KINDS = frozenset(re.findall(r"'(\w+)'", " ".join(p for _, _, p in RULES))) | ASSIGNMENT_KINDS
ORDER = {code: i for i, (code, _, _) in enumerate(RULES)}
MESSAGES = {code: message for code, message, _ in RULES}


def syntax_diagnostics(nodes: DataFrame, extra: tuple = ()) -> DataFrame:
    """All rules, and further ones of the caller's (code, message, predicate), in a single scan without a shuffle."""
    made = F.array(*[F.when(F.expr(p), F.struct(F.lit(i).alias("ord"), F.lit(c).alias("code"), F.lit(m).alias("message"))) for i, (c, m, p) in enumerate([*RULES, *extra])])
    hits = nodes.withColumn("hit", F.explode(F.filter(made, lambda x: x.isNotNull())))
    return hits.select("file_idx", "pre", "hit.ord", "hit.code", "line", "col", "hit.message", "file")


def _found(rows: DataFrame, code: str) -> DataFrame:
    return rows.select("file_idx", "pre", F.lit(ORDER[code]).alias("ord"), F.lit(code).alias("code"), "line", "col", F.lit(MESSAGES[code]).alias("message"), "file")


def mixed_assignment_style(nodes: DataFrame) -> DataFrame:
    """Per process: the first assignment whose kind differs from the first one's.

    The first assignment of every kind, then the first of the others: partial sums before the shuffle, no sort of a process.
    """
    a = nodes.where(F.col("kind").isin(*sorted(ASSIGNMENT_KINDS)) & F.col("proc_pre").isNotNull())
    firsts = a.groupBy("file_idx", "proc_pre", "kind").agg(F.min(F.struct("pre", "line", "col", "file")).alias("at"))
    both = firsts.groupBy("file_idx", "proc_pre").agg(F.array_sort(F.collect_list("at")).alias("ats")).where("size(ats) > 1")  # one entry for each kind
    return _found(both.select("file_idx", F.col("ats")[1].alias("at")).select("file_idx", "at.pre", "at.line", "at.col", "at.file"), "NO_MIXED_ASSIGNMENT_STYLE")


def latch_in_always_comb(nodes: DataFrame) -> DataFrame:
    """always_comb blocks with a target assigned under an if without else before any unconditional assignment of it."""
    marks = nodes.where("comb_role IS NOT NULL").select("file_idx", "proc_pre", "name", "comb_pos", "comb_role")
    per = marks.groupBy("file_idx", "proc_pre", "name").agg(F.min(F.when(F.col("comb_role") == "cond", F.col("comb_pos"))).alias("cond"), F.min(F.when(F.col("comb_role") == "credit", F.col("comb_pos"))).alias("credit"))
    bad = per.where("cond IS NOT NULL AND (credit IS NULL OR credit > cond)").select("file_idx", F.col("proc_pre").alias("pre")).distinct()
    return _found(nodes.where("kind = 'AlwaysCombBlock'").join(bad, ["file_idx", "pre"]), "NO_LATCH_IN_ALWAYS_COMB")


def columns_of(code: str) -> list[str]:
    """What `rule` reads of the node table for one rule."""
    base = ["file_idx", "file", "pre", "kind", "line", "col"]
    if code == "NO_MIXED_ASSIGNMENT_STYLE":
        return [*base, "proc_pre"]
    if code == "NO_LATCH_IN_ALWAYS_COMB":
        return [*base, "proc_pre", "name", "comb_pos", "comb_role"]
    return base + [c for c in ("in_always", "in_comb", "in_case_gen", "in_default", "pragma", "direction") if c in RULES[ORDER[code]][2]]


def rule(nodes: DataFrame, code: str) -> DataFrame:
    """Diagnostics of one rule; a plain rule prunes to its own predicate."""
    if code == "NO_MIXED_ASSIGNMENT_STYLE":
        return mixed_assignment_style(nodes)
    if code == "NO_LATCH_IN_ALWAYS_COMB":
        return latch_in_always_comb(nodes)
    return _found(nodes.where(RULES[ORDER[code]][2]), code)
