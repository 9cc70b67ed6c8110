"""Syntax trees as rows: one row per node in pre-order, with inherited context.

`A.pre <= B.pre AND B.pre <= A.last` within a file means that A is B or an ancestor
of B.  Context that the rules need (scope, flags, enclosing process, access mode,
port-ness) is an inherited attribute and is computed in the same walk, so that
no self-join of the node table is needed; `operators.containment` has the declarative
definitions as containment joins.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .verilog_parser import ASSIGNMENT_KINDS, COMPOUND_KINDS, Leaf, Node, parse

_COLUMNS = [
    ("file_idx", "int"), ("file", "string"), ("pre", "int"), ("last", "int"), ("parent", "int"), ("depth", "int"), ("ord", "int"), ("is_token", "boolean"),
    ("kind", "string"), ("cls", "string"), ("role", "string"), ("text", "string"), ("line", "int"), ("col", "int"), ("name", "string"),
    ("scope_pre", "int"), ("in_always", "boolean"), ("in_comb", "boolean"), ("in_latch", "boolean"), ("in_case_gen", "boolean"), ("in_default", "boolean"),
    ("in_posedge", "boolean"), ("in_negedge", "boolean"), ("proc_pre", "int"), ("proc_kind", "string"), ("proc_line", "int"), ("proc_col", "int"),
    ("read", "boolean"), ("write", "boolean"), ("is_port", "boolean"), ("has_init", "boolean"), ("direction", "string"), ("pragma", "boolean"),
    ("comb_pos", "int"), ("comb_role", "string"), ("stmt_pre", "int"), ("stmt_line", "int"), ("stmt_col", "int"), ("nettype_none", "boolean"),
    ("start", "int"), ("stop", "int"), ("mixed", "boolean"), ("latch", "boolean"),
]
SCHEMA = ", ".join(f"{n} {t}" for n, t in _COLUMNS)
_TYPE = dict(_COLUMNS)
_ARROW = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
_NAMES = [n for n, _ in _COLUMNS]


class Context(NamedTuple):
    """What a node inherits: its scope, flags, process, access mode and statement; places are numbers of nodes."""

    scope_pre: int = -1
    in_always: bool = False
    in_comb: bool = False
    in_latch: bool = False
    in_case_gen: bool = False
    in_default: bool = False
    in_posedge: bool = False
    in_negedge: bool = False
    proc_pre: int | None = None
    proc_kind: str | None = None
    read: bool = True
    write: bool = False
    is_port: bool = False
    stmt_pre: int | None = None


_WRITE_UNARY = {"UnaryPreincrementExpression", "UnaryPredecrementExpression", "PostincrementExpression", "PostdecrementExpression"}
_NETTYPE = re.compile(r"^\s*`default_nettype\s+none\b", re.M)
_CASES = {"CaseKeyword", "CaseXKeyword", "CaseZKeyword"}
_BLOCKS = {"SequentialBlockStatement", "ParallelBlockStatement"}


def default_nettype_none(text: str) -> bool:
    return bool(_NETTYPE.search(text))


def _child(node: Node, role: str):
    return next((c for c in node.children if c.role == role), None)


def _target(node) -> str | None:
    """Name that an assignment node assigns, if its left side is a plain or selected identifier."""
    if isinstance(node, Node) and node.kind in ASSIGNMENT_KINDS:
        left = _child(node, "left")
        if left is not None and left.kind in ("IdentifierName", "IdentifierSelectName"):
            return _child(left, "identifier").token.text or None
    return None


def _items(node: Node) -> list[Node]:
    held = _child(node, "items")
    return [c for c in held.children if isinstance(c, Node)] if held is not None else []


def _comb_marks(block: Node) -> dict[int, tuple[int, str]]:
    """For an always_comb block: id of assignment node -> (position of its top-level statement, cond or credit)."""
    body = _child(block, "statement")
    marks: dict[int, tuple[int, str]] = {}
    if body is None:
        return marks
    top = _items(body) if body.kind in _BLOCKS else [body]
    for pos, child in enumerate(top):
        if child.kind == "ConditionalStatement":
            if _child(child, "elseClause") is None and (branch := _child(child, "statement")) is not None:
                stack = [branch]
                while stack:
                    n = stack.pop()
                    if _target(n):
                        marks[id(n)] = (pos, "cond")
                    stack += [c for c in n.children if isinstance(c, Node) and c.cls != "ProceduralBlock"]
            continue
        stack = [child]
        while stack:
            n = stack.pop()
            if n.kind in _BLOCKS:
                stack += [c for c in _items(n) if c.kind != "ConditionalStatement"]
            else:
                value = _child(n, "expr")
                if _target(value):
                    marks[id(value)] = (pos, "credit")
    return marks


class Table:
    """The nodes of a source text in pre-order, column by column; a column is made when it is asked for."""

    def __init__(self, file_idx: int, file: str, text: str, headers: dict[str, str] | None = None, folders: tuple[str, ...] = ()):
        self.file_idx, self.file, self.source = file_idx, file, text
        self.nodes, self.up, self.deep, self.nth, self.seen = [], [], [], [], []
        self.extra: dict[str, dict[int, object]] = {k: {} for k in ("name", "has_init", "direction", "comb_pos", "comb_role")}
        self._walk(parse(text, headers, file or "", folders))
        self.made: dict[str, list] = {}
        self._inside()

    def _walk(self, root: Node) -> None:
        nodes, up, deep, nth, seen = self.nodes, self.up, self.deep, self.nth, self.seen
        marks: dict[int, tuple[int, str]] = {}
        stack: list = [(root, None, 0, 0, Context())]
        while stack:
            node, parent, depth, ord_, ctx = stack.pop()
            pre = len(nodes)
            nodes.append(node)
            up.append(parent)
            deep.append(depth)
            nth.append(ord_)
            if isinstance(node, Leaf):
                seen.append(ctx)
                continue
            own, down = self._enter(node, pre, ctx, marks)
            seen.append(own)
            kind, kids = node.kind, node.children
            if kind in ASSIGNMENT_KINDS:
                side, mode = "left", {"read": kind in COMPOUND_KINDS, "write": True}
            elif kind in _WRITE_UNARY:
                side, mode = "operand", {"read": True, "write": True}
            else:
                side = None
            # the innermost assignment whose left side, or step whose operand, holds the node decides its access
            for i in range(len(kids) - 1, -1, -1):
                c = kids[i]
                stack.append((c, pre, depth + 1, i, down._replace(**mode) if side and c.role == side and isinstance(c, Node) else down))

    def _enter(self, node: Node, pre: int, ctx: Context, marks: dict) -> tuple[Context, Context]:
        """Context of a node and of its children; notes what the node itself says."""
        cls, kind, note = node.cls, node.kind, self.extra
        down = ctx
        if cls == "ModuleDeclaration":
            note["name"][pre] = _child(_child(node, "header"), "name").token.text or "<anonymous>"
            down = ctx = ctx._replace(scope_pre=pre)
        elif cls == "ProceduralBlock":
            down = ctx._replace(proc_pre=pre, proc_kind=kind)
            flag = {"AlwaysBlock": "in_always", "AlwaysCombBlock": "in_comb", "AlwaysLatchBlock": "in_latch"}.get(kind)
            if flag:
                down = down._replace(**{flag: True})
            if kind == "AlwaysCombBlock":
                marks |= _comb_marks(node)
        elif kind == "CaseGenerate":
            if _child(node, "keyword").token.text == "case" and _child(node, "endCase").token.text == "endcase":
                down = ctx._replace(in_case_gen=True, in_default=ctx.in_default or any(c.kind == "DefaultCaseItem" for c in _items(node)))
        elif kind == "SignalEventExpression":
            edge = _child(node, "edge")
            if edge is not None and edge.token.text in ("posedge", "negedge"):
                down = ctx._replace(**{"in_" + edge.token.text: True})
        elif cls in ("ImplicitAnsiPort", "ExplicitAnsiPort", "PortDeclaration"):
            down = ctx._replace(is_port=True)
            header = _child(node, "header")
            direction = _child(header, "direction") if header is not None else None
            if direction is not None:
                note["direction"][pre] = direction.token.kind
        elif cls == "DataDeclaration":
            down = ctx._replace(is_port=False)
        elif cls == "HierarchyInstantiation":
            note["name"][pre] = _child(node, "type").token.text or None
            down = ctx._replace(stmt_pre=pre)
        elif cls == "HierarchicalInstance":
            decl = _child(node, "decl")
            note["name"][pre] = (_child(decl, "name").token.text or None) if decl is not None else None
        elif cls == "Declarator":
            note["name"][pre] = _child(node, "name").token.text or None
            note["has_init"][pre] = _child(node, "initializer") is not None
        elif kind in ("IdentifierName", "IdentifierSelectName"):
            note["name"][pre] = _child(node, "identifier").token.text or None
        if kind in ASSIGNMENT_KINDS:
            note["name"][pre] = _target(node)
            if id(node) in marks:
                note["comb_pos"][pre], note["comb_role"][pre] = marks[id(node)]
        return ctx, down

    def _inside(self) -> None:
        """What nodes get from those below them: the last one, the place of the first token, and the characters they span."""
        n = len(self.nodes)
        last, first, start, stop = list(range(n)), [None] * n, [None] * n, [None] * n
        for i in range(n - 1, -1, -1):
            node, p = self.nodes[i], self.up[i]
            if isinstance(node, Leaf):
                t = node.token
                first[i] = (t.line, t.col)
                if t.start >= 0 and t.text:
                    start[i], stop[i] = t.start, t.stop
            if p is not None:
                last[p] = max(last[p], last[i])
                first[p] = first[i] or first[p]
                if start[i] is not None:
                    start[p] = start[i]
                    stop[p] = stop[i] if stop[p] is None else max(stop[p], stop[i])
        self.last, self.first, self.start, self.stop = last, first, start, stop

    def column(self, name: str) -> list:
        if name not in self.made:
            self.made[name] = self._make(name)
        return self.made[name]

    def _make(self, name: str) -> list:
        nodes, n = self.nodes, len(self.nodes)
        if name in Context._fields:
            k = Context._fields.index(name)
            return [c[k] for c in self.seen]
        if name in ("name", "direction", "comb_pos", "comb_role"):
            return [self.extra[name].get(i) for i in range(n)]
        if name == "has_init":
            return [bool(self.extra[name].get(i)) for i in range(n)]
        if name in ("proc_line", "proc_col", "stmt_line", "stmt_col"):
            k, at = int(name.endswith("col")), self.column(name[:4] + "_pre")
            return [None if p is None else (self.first[p] or (0, 0))[k] for p in at]
        if name in ("pragma", "mixed", "latch"):
            return {"pragma": self._pragma, "mixed": self._mixed, "latch": self._latch}[name]()
        made = {
            "file_idx": lambda: [self.file_idx] * n, "file": lambda: [self.file if p or isinstance(x, Leaf) else None for x, p in zip(nodes, self.first)], "pre": lambda: list(range(n)), "last": lambda: self.last,
            "parent": lambda: self.up, "depth": lambda: self.deep, "ord": lambda: self.nth, "is_token": lambda: [isinstance(x, Leaf) for x in nodes], "kind": lambda: self.kinds(),
            "cls": lambda: ["Token" if isinstance(x, Leaf) else x.cls for x in nodes], "role": lambda: [x.role for x in nodes], "text": lambda: [x.token.text if isinstance(x, Leaf) else None for x in nodes],
            "line": lambda: [(p or (0, 0))[0] for p in self.first], "col": lambda: [(p or (0, 0))[1] for p in self.first], "nettype_none": lambda: [default_nettype_none(self.source)] * n,
            "start": lambda: self.start, "stop": lambda: self.stop,
        }
        return made[name]()

    def kinds(self) -> list[str]:
        return [x.token.kind if isinstance(x, Leaf) else x.kind for x in self.nodes]

    def _pragma(self) -> list[bool]:
        lines = None
        out = [False] * len(self.nodes)
        for i, x in enumerate(self.nodes):
            if isinstance(x, Leaf) and x.token.kind in _CASES and x.token.line > 1:
                lines = self.source.split("\n") if lines is None else lines
                above = lines[x.token.line - 2].lower() if x.token.line - 2 < len(lines) else ""
                out[i] = "full_case" in above or "parallel_case" in above
        return out

    def _mixed(self) -> list[bool]:
        """The first assignment of a process whose kind differs from that of the first one."""
        out, first = [False] * len(self.nodes), {}
        for i, x in enumerate(self.nodes):
            at = self.seen[i].proc_pre
            if at is not None and not isinstance(x, Leaf) and x.kind in ASSIGNMENT_KINDS:
                kind = first.setdefault(at, x.kind)
                if kind and kind != x.kind:
                    out[i], first[at] = True, ""
        return out

    def _latch(self) -> list[bool]:
        """always_comb blocks with a target assigned under an if without else before any unconditional assignment of it."""
        low: dict[tuple, dict[str, int]] = {}
        for i, role in self.extra["comb_role"].items():
            per = low.setdefault((self.seen[i].proc_pre, self.extra["name"][i]), {})
            per[role] = min(per.get(role, 1 << 30), self.extra["comb_pos"][i])
        out = [False] * len(self.nodes)
        for (at, _), per in low.items():
            out[at] = out[at] or per.get("cond", 1 << 30) < per.get("credit", 1 << 30)
        return out

    def picked(self, kinds: frozenset | None) -> list[int] | None:
        """Nodes whose kind or class is wanted; None for all."""
        if kinds is None:
            return None
        return [i for i, x in enumerate(self.nodes) if (x.token.kind if isinstance(x, Leaf) else x.kind) in kinds or not isinstance(x, Leaf) and x.cls in kinds]


def rows(file_idx: int, file: str, text: str, headers: dict[str, str] | None = None, folders: tuple[str, ...] = ()) -> list[dict]:
    """All nodes of a source text with all columns, in pre-order."""
    table = Table(file_idx, file, text, headers, folders)
    return [dict(zip(_NAMES, x)) for x in zip(*(table.column(c) for c in _NAMES))]


def snippet(text: str, row: dict) -> str:
    """Source text of a node, without what stands around it; a token that is not in the source gives its own text."""
    if row["start"] is None:
        return (row["text"] or "") if row["is_token"] else ""
    return text[row["start"] : row["stop"]]


def parse_files(files: DataFrame, columns: list[str] | None = None, kinds: frozenset | None = None, headers: dict[str, str] | None = None, folders: tuple[str, ...] = ()) -> DataFrame:
    """(file_idx, path, text) -> node rows; null text is an empty file.

    Only `columns` (default: all) are made, and only nodes whose kind or class is in `kinds` (default: all) leave the
    parser.  `headers` are the texts by path that `include may name, and `folders` where they are looked for.

    A file gives many times its own size in rows, which the optimizer cannot know.  By its estimate it would broadcast
    tables of all nodes or events and fail, so whatever comes from node rows is joined by merging sorted partitions.
    """
    names = _NAMES if columns is None else [c for c in _NAMES if c in columns]

    def run(batches):
        for batch in batches:
            held, n = {c: [] for c in names}, 0
            for i, path, text in zip(*(batch.column(c).to_pylist() for c in ("file_idx", "path", "text"))):
                table = Table(i, path, text or "", headers, folders)
                picked = table.picked(kinds)
                for c in names:
                    made = table.column(c)
                    held[c] += made if picked is None else [made[k] for k in picked]
                n = len(held[names[0]])
                if n >= 20_000:
                    yield from _sliced(held, n)
                    held, n = {c: [] for c in names}, 0
            if n:
                yield from _sliced(held, n)

    def _sliced(held, n):
        for at in range(0, n, 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(held[c][at : at + 20_000], _ARROW[_TYPE[c]]) for c in names], names=names)

    return files.select("file_idx", "path", "text").mapInArrow(run, ", ".join(f"{c} {_TYPE[c]}" for c in names)).hint("merge")
