"""Definitions of the inherited columns from the node table alone, by containment of intervals.

Nodes of a file nest, so the innermost of a set of outer nodes that holds a node is the top of a stack when both are read
in pre-order.  Files are the groups: one shuffle of the few columns and rows that matter, then one linear pass over a file,
which the parser holds in memory as a whole too; no pairs are formed.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.verilog_parser import ASSIGNMENT_KINDS, COMPOUND_KINDS

#: Columns of the node table that are read here.
COLUMNS = ["file_idx", "pre", "last", "parent", "kind", "cls", "role", "line", "col", "name"]


def _innermost(rows: list[dict]):
    """(inner row, innermost outer row that holds it or None), for rows of one file in pre-order; an outer row holds itself."""
    open_ = []
    for r in rows:
        while open_ and open_[-1]["last"] < r["pre"]:
            open_.pop()
        if r["is_outer"]:
            open_.append(r)
        if r["is_inner"]:
            yield r, open_[-1] if open_ else None


def _in_order(table: pa.Table) -> list[dict]:
    return table.sort_by("pre").to_pylist()


def nearest_ancestor(nodes: DataFrame, inner: Column, outer: Column) -> DataFrame:
    """(file_idx, pre, kind, line, col, anc_pre, anc_kind, anc_line): innermost `outer` node that holds each `inner` node; inner nodes without one are left out."""
    rows = nodes.select("file_idx", "pre", "last", "kind", "line", "col", inner.alias("is_inner"), outer.alias("is_outer")).where("is_inner OR is_outer")

    def run(table: pa.Table) -> pa.Table:
        found = [(r["file_idx"], r["pre"], r["kind"], r["line"], r["col"], a["pre"], a["kind"], a["line"]) for r, a in _innermost(_in_order(table)) if a]
        types = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32())
        return pa.table({n: pa.array([x[i] for x in found], t) for i, (n, t) in enumerate(zip(("file_idx", "pre", "kind", "line", "col", "anc_pre", "anc_kind", "anc_line"), types))})

    return rows.groupBy("file_idx").applyInArrow(run, "file_idx int, pre int, kind string, line int, col int, anc_pre int, anc_kind string, anc_line int")


_STEPS = ("UnaryPreincrementExpression", "UnaryPredecrementExpression", "PostincrementExpression", "PostdecrementExpression")


def access_mode(nodes: DataFrame) -> DataFrame:
    """(file_idx, pre, name, line, col, read, write) of identifiers, by the innermost written side that holds them."""
    names = F.col("cls").isin("IdentifierName", "IdentifierSelectName") & F.col("name").isNotNull()
    writers = F.col("kind").isin(*sorted(ASSIGNMENT_KINDS), *_STEPS)
    rows = nodes.select("file_idx", "pre", "last", "parent", "kind", "role", "line", "col", "name", names.alias("is_inner"), writers.alias("writes")).where("is_inner OR writes OR role IN ('left', 'operand')")

    def run(table: pa.Table) -> pa.Table:
        rows = _in_order(table)
        kinds = {r["pre"]: r["kind"] for r in rows if r["writes"]}
        for r in rows:
            up = kinds.get(r["parent"])
            r["is_outer"] = up in ASSIGNMENT_KINDS and r["role"] == "left" or up in _STEPS and r["role"] == "operand"
        found = [(r["file_idx"], r["pre"], r["name"], r["line"], r["col"], a is None or a["role"] == "operand" or kinds[a["parent"]] in COMPOUND_KINDS, a is not None) for r, a in _innermost(rows)]
        types = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
        return pa.table({n: pa.array([x[i] for x in found], t) for i, (n, t) in enumerate(zip(("file_idx", "pre", "name", "line", "col", "read", "write"), types))})

    return rows.groupBy("file_idx").applyInArrow(run, "file_idx int, pre int, name string, line int, col int, read boolean, write boolean")
