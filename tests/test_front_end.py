"""Lexer, parser and node table."""

import pytest

from gatewright.sources.nodes import rows
from gatewright.sources.verilog_lexer import lex
from gatewright.sources.verilog_parser import parse

SMALL = "module m(input logic c);\n  real x;\n  always @(posedge c) begin\n    x = 1;\n  end\nendmodule\n"


def kinds(text):
    return [r["kind"] for r in rows(0, "f.v", text)]


def test_tokens_have_places():
    got = [(t.kind, t.text, t.line, t.col) for t in lex("a <= 8'hFF; // x\n/* y\n */ b")]
    assert got == [("Identifier", "a", 1, 1), ("LessThanEquals", "<=", 1, 3), ("IntegerLiteral", "8", 1, 6), ("IntegerBase", "'h", 1, 7), ("IntegerLiteral", "FF", 1, 9), ("Semicolon", ";", 1, 11), ("Identifier", "b", 3, 5)]


def test_conditional_compilation_and_macros():
    assert [t.text for t in lex("`define W 4\n`ifdef W\nx[`W]\n`else\ny\n`endif\n`ifndef W z `endif")] == ["x", "[", "4", "]"]
    assert [t.text for t in lex("`define A `A\n`A b")] == ["b"]  # a macro of itself ends


def test_pre_order_intervals_nest():
    table = rows(0, "f.v", SMALL)
    assert [r["pre"] for r in table] == list(range(len(table)))
    for r in table[1:]:
        up = table[r["parent"]]
        assert up["pre"] < r["pre"] <= r["last"] <= up["last"] and r["depth"] == up["depth"] + 1


def test_small_tree():
    got = kinds(SMALL)
    assert got[:5] == ["CompilationUnit", "SyntaxList", "ModuleDeclaration", "SyntaxList", "ModuleHeader"]
    for k in ("ImplicitAnsiPort", "Declarator", "AlwaysBlock", "TimingControlStatement", "SignalEventExpression", "SequentialBlockStatement", "AssignmentExpression"):
        assert k in got
    assert got[-1] == "EndOfFile"


def test_recovered_case_arm():
    """A non-declaration in a generate arm is a type name, then an arm with an empty name."""
    table = rows(0, "f.v", "module m;\n  case(s)\n    0: o = a;\n  endcase\nendmodule\n")
    tail = [(r["kind"], r["text"], r["line"], r["col"]) for r in table if r["is_token"]][8:]
    assert tail[:8] == [("Colon", ":", 3, 6), ("Identifier", "o", 3, 8), ("Semicolon", ";", 3, 9), ("Identifier", "", 3, 10), ("Equals", "=", 3, 10), ("Identifier", "a", 3, 12), ("Colon", ":", 3, 13), ("Semicolon", ";", 3, 13)]
    assert [r["kind"] for r in table].count("StandardCaseItem") == 2 and "NamedType" in [r["kind"] for r in table]


@pytest.mark.parametrize("text", ["", "\n", "end end", "module", "module m; @#$% foo bar( endmodule", "`ifdef", "(((", "always @(", "class c; endclass", "module m; x.y.z; if endmodule", '"', "\\esc ", "/*"])
def test_no_text_fails(text):
    assert rows(0, "f.v", text)[0]["kind"] == "CompilationUnit"


def test_deep_nesting_ends():
    parse("module m; assign a = " + "(" * 5000 + "b" + ")" * 5000 + "; endmodule")
    assert len(rows(0, "f.v", "module m; always begin " * 3000)) > 1000


def access(text):
    return [(r["name"], r["read"], r["write"]) for r in rows(0, "f.v", f"module m; always_comb begin {text} end endmodule") if r["cls"] in ("IdentifierName", "IdentifierSelectName")]


@pytest.mark.parametrize(
    "text,want",
    [
        ("x = y;", [("x", False, True), ("y", True, False)]),
        ("x += y;", [("x", True, True), ("y", True, False)]),
        ("++x;", [("x", True, True)]),
        ("x--;", [("x", True, True)]),
        ("m[i] = x;", [("m", False, True), ("i", False, True), ("x", True, False)]),
        ("{a, b} = c;", [("a", False, True), ("b", False, True), ("c", True, False)]),
        ("s.f <= c;", [("s", False, True), ("f", False, True), ("c", True, False)]),
        ("if (a <= b) c = 1;", [("a", True, False), ("b", True, False), ("c", False, True)]),
    ],
)
def test_access_modes(text, want):
    assert access(text) == want


def texts(source, files=None, path="d/top.v", folders=()):
    from gatewright.sources.verilog_lexer import Source

    return [t.text for t in lex(source, Source(files, path, folders))]


@pytest.mark.parametrize(
    "source,want",
    [
        ("`define F(x) x+1\nassign a = `F(b);", "assign a = b + 1 ;"),
        ("`define F(x, y = 2) x*y // c\n`F(a) `F((p, q), [r, s]) `F( , t)", "a * 2 ( p , q ) * [ r , s ] * t"),
        ("`define N(a) a``_x\n`N(sig)", "sig_x"),
        ('`define S(a) `"a`" "a"\n`S(b)', '"b" "a"'),
        ("`define A(x) `B(x)+x\n`define B(y) (y)\n`A(1)", "( 1 ) + 1"),
        ("`define L(x) begin \\\n x; \\\n end\n`L(\n  z)", "begin z ; end"),
        ("`define F(x) x y\n`F", "y"),
    ],
)
def test_macros_with_arguments(source, want):
    assert " ".join(texts(source)) == want


def test_lines_after_a_long_use():
    got = lex("`define F(x, y) x y\n`F(a,\n  b) c")
    assert [(t.text, t.line, t.col) for t in got] == [("a", 2, 1), ("b", 2, 1), ("c", 3, 6)]


def test_includes():
    files = {"d/a.vh": '`define W 3\n`include "sub/b.vh"\nx', "d/sub/b.vh": "y[`W]", "inc/c.vh": "z", "d/loop.vh": '`include "loop.vh"\nw'}
    assert texts('`include "a.vh"\n`include <c.vh> // rest\n`W `include "gone.vh"\nend', files, folders=("inc",)) == ["y", "[", "3", "]", "x", "z", "3", "end"]
    assert texts('`include "loop.vh"\nq', files) == ["w", "q"]
    assert texts('`ifdef NO\n`include "a.vh"\n`endif\nq', files) == ["q"]
    far = {"s3a://bucket/d/a.vh": "k"}
    assert texts('`include "../d/a.vh"', far, "s3a://bucket/e/top.v") == ["k"]


def test_deep_macros_stay_visible():
    from gatewright.sources.verilog_lexer import DEEPEST

    chain = "".join(f"`define M{i} `M{i + 1}\n" for i in range(DEEPEST + 5)) + f"`define M{DEEPEST + 5} end_\n"
    assert texts(chain + "`M0") == [f"`M{DEEPEST}"] and texts(chain + "`M50") == ["end_"]


def test_lines_end_at_line_feeds_only():
    form = "module m;\n// a\f\u2028b full_case\ncase (s) endcase\nendmodule"
    assert [r["pragma"] for r in rows(0, "f.v", form) if r["kind"] == "CaseKeyword"] == [True]
    off = "module m;\n// full_case\f\n\ncase (s) endcase\nendmodule"
    assert [r["pragma"] for r in rows(0, "f.v", off) if r["kind"] == "CaseKeyword"] == [False]


def test_snippets():
    from gatewright.sources.nodes import snippet

    table = rows(0, "f.v", SMALL)
    said = {(r["kind"], r["line"]): snippet(SMALL, r) for r in reversed(table)}
    assert said["CompilationUnit", 1] == SMALL.rstrip("\n") and said["DataDeclaration", 2] == "real x;" and said["RealType", 2] == "real"
    assert said["SequentialBlockStatement", 3] == "begin\n    x = 1;\n  end" and said["AssignmentExpression", 4] == "x = 1" and said["EndOfFile", 7] == ""
    made = rows(0, "f.v", "`define Q zz\nmodule m; wire `Q; endmodule")
    assert [snippet("", r) for r in made if r["text"] == "zz"] == ["zz"]


# Kind and place of every node of a small file, in pre-order.
WALK_SOURCE = "module top(input logic clk);\n  real x;\n  always @(posedge clk) begin\n    a = b;\n    c <= d;\n  end\n  always_comb begin\n    y <= z;\n  end\n  case(sel)\n    0: out = a;\n  endcase\nendmodule\n"
WALK = """
CompilationUnit 1:1|SyntaxList 1:1|ModuleDeclaration 1:1|SyntaxList 0:0|ModuleHeader 1:1|ModuleKeyword 1:1|Identifier 1:8|SyntaxList 0:0|AnsiPortList 1:11|OpenParenthesis 1:11
SeparatedList 1:12|ImplicitAnsiPort 1:12|SyntaxList 0:0|VariablePortHeader 1:12|InputKeyword 1:12|LogicType 1:18|LogicKeyword 1:18|SyntaxList 0:0|Declarator 1:24|Identifier 1:24
SyntaxList 0:0|CloseParenthesis 1:27|Semicolon 1:28|SyntaxList 2:3|DataDeclaration 2:3|SyntaxList 0:0|TokenList 0:0|RealType 2:3|RealKeyword 2:3|SeparatedList 2:8|Declarator 2:8
Identifier 2:8|SyntaxList 0:0|Semicolon 2:9|AlwaysBlock 3:3|SyntaxList 0:0|AlwaysKeyword 3:3|TimingControlStatement 3:10|SyntaxList 0:0|EventControlWithExpression 3:10|At 3:10
ParenthesizedEventExpression 3:11|OpenParenthesis 3:11|SignalEventExpression 3:12|PosEdgeKeyword 3:12|IdentifierName 3:20|Identifier 3:20|CloseParenthesis 3:23
SequentialBlockStatement 3:25|SyntaxList 0:0|BeginKeyword 3:25|SyntaxList 4:5|ExpressionStatement 4:5|SyntaxList 0:0|AssignmentExpression 4:5|IdentifierName 4:5|Identifier 4:5
Equals 4:7|SyntaxList 0:0|IdentifierName 4:9|Identifier 4:9|Semicolon 4:10|ExpressionStatement 5:5|SyntaxList 0:0|NonblockingAssignmentExpression 5:5|IdentifierName 5:5
Identifier 5:5|LessThanEquals 5:7|SyntaxList 0:0|IdentifierName 5:10|Identifier 5:10|Semicolon 5:11|EndKeyword 6:3|AlwaysCombBlock 7:3|SyntaxList 0:0|AlwaysCombKeyword 7:3
SequentialBlockStatement 7:15|SyntaxList 0:0|BeginKeyword 7:15|SyntaxList 8:5|ExpressionStatement 8:5|SyntaxList 0:0|NonblockingAssignmentExpression 8:5|IdentifierName 8:5
Identifier 8:5|LessThanEquals 8:7|SyntaxList 0:0|IdentifierName 8:10|Identifier 8:10|Semicolon 8:11|EndKeyword 9:3|CaseGenerate 10:3|SyntaxList 0:0|CaseKeyword 10:3
OpenParenthesis 10:7|IdentifierName 10:8|Identifier 10:8|CloseParenthesis 10:11|SyntaxList 11:5|StandardCaseItem 11:5|SeparatedList 11:5|IntegerLiteralExpression 11:5
IntegerLiteral 11:5|Colon 11:6|DataDeclaration 11:8|SyntaxList 0:0|TokenList 0:0|NamedType 11:8|IdentifierName 11:8|Identifier 11:8|SeparatedList 0:0|Semicolon 11:11
StandardCaseItem 11:12|SeparatedList 11:12|AssignmentExpression 11:12|IdentifierName 11:12|Identifier 11:12|Equals 11:12|SyntaxList 0:0|IdentifierName 11:14|Identifier 11:14
Colon 11:15|EmptyMember 11:15|SyntaxList 0:0|TokenList 0:0|Semicolon 11:15|EndCaseKeyword 12:3|EndModuleKeyword 13:1|EndOfFile 14:1
"""


def test_walk_of_a_small_file():
    got = [f"{r['kind']} {r['line']}:{r['col']}" for r in rows(0, "f.v", WALK_SOURCE)]
    assert len(got) == 129 and got == WALK.strip().replace("\n", "|").split("|")


def test_columns_and_kinds_are_pruned(spark):
    from gatewright.sources.nodes import parse_files

    files = spark.createDataFrame([(0, "a.v", SMALL), (1, "b.v", None)], "file_idx int, path string, text string")
    some = parse_files(files, ["pre", "kind", "file_idx"], frozenset({"Equals", "ModuleDeclaration"}))
    assert some.columns == ["file_idx", "pre", "kind"]
    want = [(0, r["pre"], r["kind"]) for r in rows(0, "a.v", SMALL) if r["kind"] in ("Equals", "ModuleDeclaration")]
    assert [tuple(r) for r in some.orderBy("pre").collect()] == want and parse_files(files).where("file_idx = 1").count() > 0


def test_edges_of_events():
    table = rows(0, "f.v", "module m; always @(posedge a or negedge b) c = 1; endmodule")
    flags = {r["name"]: (r["in_posedge"], r["in_negedge"]) for r in table if r["kind"] == "IdentifierName"}
    assert flags == {"a": (True, False), "b": (False, True), "c": (False, False)}
