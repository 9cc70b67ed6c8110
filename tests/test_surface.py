"""Listing, command line and error contract."""

import pytest

from gatewright.__main__ import main
from gatewright.plans.lint import lint
from gatewright.sources.files import collect_paths


def test_collect_order(tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("b.v", "a.sv", "d/a.v", "c.txt"):
        (tmp_path / name).write_text("")
    assert [p.relative_to(tmp_path).as_posix() for p in collect_paths([str(tmp_path)])] == ["b.v", "d/a.v", "a.sv"]
    assert [p.name for p in collect_paths([str(tmp_path / "c.txt"), "gone"])] == ["c.txt", "gone"]


def test_command_line(spark, tmp_path, capsys):
    good, bad = tmp_path / "good.v", tmp_path / "bad.v"
    good.write_text("module a; endmodule\n")
    bad.write_text("module b;\n  nothing u();\nendmodule\n")
    assert main([str(good)], spark) == 0 and capsys.readouterr().out == "No issues found.\n"
    assert main([str(good), str(bad)], spark) == 0
    assert capsys.readouterr().out == f"{bad}:2:3 - [UNDEFINED_MODULE] Instantiation of undefined module 'nothing'\n"
    assert main([str(tmp_path / "none")], spark) == 1 and "file not found" in capsys.readouterr().err
    (tmp_path / "empty").mkdir()
    assert main([str(tmp_path / "empty")], spark) == 1 and "no .v or .sv files found" in capsys.readouterr().err
    assert main([str(good), "-j", "0"], spark) == 1 and "jobs must be >= 1, got 0" in capsys.readouterr().err


def test_jobs_is_partitions(spark, tmp_path):
    (tmp_path / "a.v").write_text("module a; defparam x.y = 1; endmodule\n")
    assert {r.code for r in lint(spark, [tmp_path / "a.v"], jobs=3).collect()} == {"NO_DEFPARAM", "NO_IMPLICIT_NET"}
    with pytest.raises(ValueError, match="jobs must be >= 1"):
        lint(spark, [], jobs=0)


def test_watch_lints_arriving_files(spark, tmp_path):
    from gatewright.streaming.watch import watch

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.v").write_text("module a;\n  initial x = 1;\nendmodule\n")
    (src / "b.txt").write_text("module b; initial x = 1; endmodule")
    got = []
    watch(spark, str(src), str(tmp_path / "cp"), lambda d, n: got.extend(d.collect()), once=True).awaitTermination()
    assert [(r.file.rsplit("/", 1)[-1], r.line, r.col, r.code) for r in got] == [("a.v", 2, 3, "NO_INITIAL_BLOCK")]


def test_includes_and_user_rules(spark, tmp_path):
    (tmp_path / "inc").mkdir()
    (tmp_path / "inc" / "deep.vh").write_text("`define K 1\n")
    (tmp_path / "near.vh").write_text('`include "deep.vh"\n`define BAD(x) initial x = `K;\n')
    (tmp_path / "a.v").write_text('`include "near.vh"\nmodule a;\n  reg q;\n  `BAD(q)\n  forever_thing t();\nendmodule\n')
    paths = [tmp_path / "a.v"]
    got = {(r.code, r.line, r.col) for r in lint(spark, paths, include_dirs=(str(tmp_path / "inc"),)).collect()}
    assert ("NO_INITIAL_BLOCK", 4, 3) in got and not any(c == "NO_NAMES" for c, _, _ in got)
    more = lint(spark, paths, extra=(("NO_NAMES", "No instances", "kind = 'HierarchyInstantiation'"),), include_dirs=(str(tmp_path / "inc"),)).collect()
    assert {("NO_NAMES", 5, 3), ("NO_INITIAL_BLOCK", 4, 3)} <= {(r.code, r.line, r.col) for r in more}


def test_paths_with_a_scheme(spark, tmp_path):
    (tmp_path / "a.v").write_text("module a; initial x = 1; endmodule\n")
    (tmp_path / "b.sv").write_text("module b; endmodule\n")
    found = collect_paths([tmp_path.as_uri()], spark)
    assert [str(p).rsplit("/", 1)[-1] for p in found] == ["a.v", "b.sv"]
    assert "NO_INITIAL_BLOCK" in {r.code for r in lint(spark, found).collect()}


def test_watch_keeps_files_apart(spark, tmp_path):
    from gatewright.streaming.watch import watch

    src = tmp_path / "in"
    src.mkdir()
    for i in range(40):
        (src / f"f{i}.v").write_text("module m;\n  always @(posedge c) begin a = 1; " + ("b <= 1; " if i % 2 else "b = 1; ") + "end\nendmodule\n")
    got = []
    watch(spark, str(src), str(tmp_path / "cp"), lambda d, n: got.extend(d.collect()), once=True).awaitTermination()
    mixed = sorted(int(r.file.rsplit("/f", 1)[-1][:-2]) for r in got if r.code == "NO_MIXED_ASSIGNMENT_STYLE")
    assert mixed == list(range(1, 40, 2))
