"""What scripts run: functions, commands from outside, and pipelines."""

from __future__ import annotations

from skein.operators import validate
from skein.plans.analyze import analyze

SCRIPT = """#!/bin/sh
. ./lib.sh
FOO=bar LANG=C sort -u names > out.txt 2>&1
greet() {
  local who=$1
  echo "hi | no" | tr a b
  if grep -q x f; then helper; fi
}
helper() { cat f | jq . | greet; }
case $1 in
  go | run) make all ;;
esac
x=$(date +%s) # | rm -rf
"""
POWER = "function Get-Dot { Get-Item x | Set-Dot }\nfunction Set-Dot { Write-Host y }\n"


def test_commands_and_pipelines(spark, tmp_path):
    (tmp_path / "run.sh").write_text(SCRIPT)
    (tmp_path / "lib.sh").write_text("")
    (tmp_path / "p.ps1").write_text(POWER)
    g = analyze(spark, str(tmp_path))
    assert validate.violations(g).count() == 0
    name = {r.id: r.qualified_name.split("/")[-1] for r in g.nodes.collect()}
    edges = [(r.relation_type, name[r.source_id], name[r.target_id], r.resolution_status, r.confidence) for r in g.edges.collect()]
    uses = {x[1:3] for x in edges if x[0] == "uses"}
    sh = "run.sh"
    assert {x for x in uses if x[0].startswith(sh)} == {(sh, "sort"), (sh, "make"), (sh, "date"), ("run.sh.greet", "echo"), ("run.sh.greet", "tr"), ("run.sh.greet", "grep"), ("run.sh.helper", "cat"), ("run.sh.helper", "jq")}
    assert {x[1:4] for x in edges if x[0] == "calls"} == {("run.sh.greet", "run.sh.helper", "resolved"), ("run.sh.helper", "run.sh.greet", "resolved"), ("p.ps1.Get-Dot", "p.ps1.Set-Dot", "resolved")}
    assert {x[1:3] for x in edges if x[0] == "handles"} == {("echo", "tr"), ("cat", "jq"), ("jq", "run.sh.greet"), ("Get-Item", "p.ps1.Set-Dot")}
    assert all(x[4] == 0.9 and x[3] == "external" for x in edges if x[0] == "uses")
    assert ("p.ps1.Get-Dot", "Get-Item") in uses and ("p.ps1.Set-Dot", "Write-Host") in uses
