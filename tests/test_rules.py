"""Rules on parsed text and resolution against a step-by-step simulation."""

import random

import pytest
from pyspark.sql import functions as F

from gatewright.operators import resolution
from gatewright.plans import lint as L
from gatewright.plans.facts import GLOBAL
from gatewright.sources.nodes import SCHEMA, default_nettype_none, rows
from gatewright.sources.files import nettype_none


@pytest.fixture(scope="module")
def lint(spark):
    def run(*texts):
        """One plan for many cases: {case: [diagnostics as text]}; every case is a list of files."""
        out = []
        for case in texts:
            table = [r for i, t in enumerate(case) for r in rows(i, f"f{i}.v", t)]
            nodes = spark.createDataFrame(table, SCHEMA)
            facts = L.derive(nodes)
            out.append([f"{r.file}:{r.line}:{r.col} {r.code}" + (" " + r.message.split("'")[1] if "'" in r.message else "") for r in L.diagnostics(facts).orderBy(*L.KEYS).collect()])
            facts.release()
        return out

    return run


def test_example_with_many_findings(lint):
    text = "module t(input logic k);\n  real u;\n  always @(posedge k) begin\n    a = b;\n    c <= d;\n  end\n  always_comb begin\n    y <= z;\n  end\n  case(sel)\n    0: out = a;\n  endcase\nendmodule\n"
    assert lint([text])[0] == [
        "f0.v:4:7 NO_BLOCKING_SEQUENTIAL", "f0.v:5:5 NO_MIXED_ASSIGNMENT_STYLE", "f0.v:8:7 NO_NONBLOCKING_COMBINATIONAL", "f0.v:10:3 NO_CASE_GENERATE", "f0.v:12:3 DEFAULT_CASE", "f0.v:2:8 UNUSED_VARIABLE u",
        *[f"f0.v:{p} NO_IMPLICIT_NET {n}" for p, n in (("4:5", "a"), ("4:9", "b"), ("5:5", "c"), ("5:10", "d"), ("8:5", "y"), ("8:10", "z"), ("10:8", "sel"), ("11:8", "out"))], "f0.v:3:20 READ_BEFORE_WRITE k",
    ]


def test_phases_over_two_files(lint):
    a = "module d;\n  real x;\nendmodule\n"
    b = "module d;\n  real y;\n  initial y = 1;\n  gone u();\nendmodule\n"
    assert lint([a, b])[0] == ["f1.v:3:3 NO_INITIAL_BLOCK", "f0.v:2:8 UNUSED_VARIABLE x", "f1.v:1:1 DUPLICATE_MODULE d", "f1.v:4:3 UNDEFINED_MODULE gone"]


def test_latch_forms(lint):
    head, tail = "module m(output logic y, input logic a);\n  always_comb begin\n", "  end\nendmodule\n"
    bare, before, other, late = lint([head + "if (a) y = 1;\n" + tail], [head + "y = 0;\nif (a) y = 1;\n" + tail], [head + "if (a) y = 1; else y = 0;\n" + tail], [head + "if (a) y = 1;\ny = 0;\n" + tail])
    code = "f0.v:2:3 NO_LATCH_IN_ALWAYS_COMB"
    assert code in bare and code in late and code not in before and code not in other


def test_nettype_none(lint, spark):
    with_, without = lint(["`default_nettype none\nmodule m;\n  assign x = 1;\nendmodule\n"], ["module m;\n  assign x = 1;\nendmodule\n"])
    assert with_ == ["f0.v:3:10 UNDECLARED_VARIABLE x"] and without == ["f0.v:2:10 NO_IMPLICIT_NET x"]
    texts = ["`default_nettype none", "  `default_nettype\tnone\n", "x `default_nettype none", "`default_nettype nonesuch", "\n\n `default_nettype none;", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(nettype_none(F.col("text"))).collect()]
    assert got == [default_nettype_none(t or "") for t in texts]


def test_drivers_and_declarations(lint):
    two = "module m(input logic k);\n  logic x = 0, x, z;\n  always_ff @(posedge k) x <= 1;\n  always_ff @(posedge k) x <= z;\nendmodule\n"

    got = lint([two])[0]
    assert {g.split(" ", 1)[1] for g in got} == {"NO_MULTIPLE_DRIVERS x", "NO_UNDRIVEN_SIGNAL z", "REDECLARED_VARIABLE x", "READ_BEFORE_WRITE k", "READ_BEFORE_WRITE z"}


def simulate(events):
    """Binding of each event, walking in order."""
    table, out = {}, []
    for scope, name, ev in events:
        if ev == "decl" or (scope, name) in table:
            to = scope
        elif (GLOBAL, name) in table:
            to = GLOBAL
        else:
            to = scope
        table[to, name] = True
        out.append(to)
    return out


def test_resolution_matches_simulation(spark):
    random.seed(3)
    made, want = [], {}
    for case in range(60):
        events = [(random.choice([GLOBAL, "a", "b"]), random.choice("xy"), random.choice(["decl", "use", "use"])) for _ in range(random.randint(1, 10))]
        for i, ((scope, name, ev), to) in enumerate(zip(events, simulate(events))):
            own = lambda s: s if s == GLOBAL else f"{s}{case}"
            made.append(((case, i, 0), own(scope), f"{name}{case}", ev))
            want[case, i] = own(to)
    e = spark.createDataFrame(made, "seq struct<file_idx:int,pre:int,sub:int>, scope_id string, name string, ev string")
    got = {(r.seq.file_idx, r.seq.pre): r.bound_scope for r in resolution.bind(e).collect()}
    assert got == want
