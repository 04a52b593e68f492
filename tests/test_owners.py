"""Names with their owners, what contains what, and calls, in languages that profiles take."""

from __future__ import annotations

import pytest

from skein.operators import validate
from skein.plans.analyze import analyze

FILES = {
    "a.vb": "Namespace Shop\nPublic Class Cart\n  Public Sub Add()\n    Check()\n  End Sub\n  Private Function Check()\n    If True Then\n    End If\n  End Function\nEnd Class\nEnd Namespace\n",
    "b.bas": 'Attribute VB_Name = "Tools"\nPublic Sub First()\nEnd Sub\nSub Second()\nEnd Sub\n',
    "c.lua": "local T = {}\nfunction T.go()\n  for i = 1, 2 do\n    low()\n  end\nend\nfunction low()\nend\n",
    "d.hs": "module D where\nlow :: Int -> Int\nlow x = x\ntop = low 2\n",
    "e.pl": "package Box;\nsub low { return 2; }\nsub top { low(); }\n",
    "f.m": "function y = low(x)\nif x\n y = x;\nend\nend\nfunction top()\nlow(3);\nend\n",
    "g.cob": "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. PAY.\n       PROCEDURE DIVISION.\n       WORK SECTION.\n       TOP.\n           PERFORM LOW.\n       LOW.\n           GOBACK.\n",
    "h.f90": "module geo\ncontains\nsubroutine low(x)\nif (x) then\nend if\nend subroutine low\nsubroutine top(x)\ncall low(x)\nend subroutine\nend module geo\n",
    "i.r": "low <- function(x, y) x + y\ntop <- function() {\n  low(1, 2)\n}\n",
    "j.mm": "@interface Bell : NSObject\n- (void)ring;\n@end\n@implementation Bell\n- (void)ring { [self shake]; }\n- (void)shake { }\n@end\n",
    "k.cu": "__global__ void kern() { }\n__device__ int low(int x) { return x; }\nint main() { return low(1); }\n",
    "l.groovy": "package tools\nclass Hammer {\n  def hit() { swing() }\n  def swing() { }\n}\n",
    "m.fs": "module Calc\nlet Low() = 1\nlet Top() = Low()\n",
    "n.asm": ".text\nstart:\n  call low\n  ret\nlow:\n  ret\n",
    "o.tf": 'variable "size" {}\nmodule "net" { source = "./net" }\nresource "vm" "box" { n = var.size }\noutput "ip" { value = vm.box }\n',
    "p.gd": "class_name Foe\nextends Node\nfunc _ready():\n    low()\nfunc low():\n    pass\n",
    "q.ex": "defmodule Calc do\n  def low(x), do: x\n  def top do\n    low(1)\n  end\nend\n",
    "r.zig": "const Pair = struct { a: i32 };\nfn low(x: i32) i32 { return x; }\npub fn main() void { _ = low(1); }\n",
    "s.jl": "module Geo\nstruct Dot\n x::Int\nend\nfunction low(x)\n x\nend\nfunction top()\n low(1)\nend\nend\n",
    "t.pas": "unit Shapes;\ninterface\ntype TDot = class\nend;\nimplementation\nprocedure Low; begin end;\nprocedure TDot.Draw; begin Low; end;\nend.\n",
    "u.erl": "-module(calc).\n-export([top/0]).\nlow() -> ok.\ntop() -> low().\n",
}
NODES = {
    "a.vb": "namespace Shop, class Shop.Cart, method Shop.Cart.Add, method Shop.Cart.Check", "b.bas": "namespace Tools, method Tools.First, method Tools.Second", "c.lua": "function T.go, function low", "d.hs": "function low, function top",
    "e.pl": "namespace Box, method Box.low, function top", "f.m": "function low, function top", "g.cob": "namespace PAY, namespace PAY.WORK, method PAY.WORK.TOP, method PAY.WORK.LOW", "h.f90": "namespace geo, method geo.low, method geo.top",
    "i.r": "function low, function top", "j.mm": "class Bell, method Bell.ring, method Bell.shake", "k.cu": "function kern, function low, function main", "l.groovy": "namespace tools, class tools.Hammer, method tools.Hammer.hit, method tools.Hammer.swing",
    "m.fs": "namespace Calc, method Calc.Low, method Calc.Top", "n.asm": "function start, function low", "o.tf": "type size, type net, type vm.box, type ip", "p.gd": "class Foe, method Foe._ready, method Foe.low", "q.ex": "namespace Calc, method Calc.low, method Calc.top",
    "r.zig": "type Pair, function low, function main", "s.jl": "namespace Geo, type Geo.Dot, method Geo.low, method Geo.top", "t.pas": "namespace Shapes, class Shapes.TDot, method Shapes.Low, method Shapes.TDot.Draw", "u.erl": "namespace calc, method calc.low, method calc.top",
}
CALLS = {
    "a.vb": "Shop.Cart.Add>Shop.Cart.Check", "b.bas": "", "c.lua": "T.go>low", "e.pl": "top>Box.low", "f.m": "top>low", "g.cob": "PAY.WORK.TOP>PAY.WORK.LOW", "h.f90": "geo.top>geo.low", "i.r": "top>low", "j.mm": "Bell.ring>Bell.shake",
    "k.cu": "main>low", "l.groovy": "tools.Hammer.hit>tools.Hammer.swing", "m.fs": "Calc.Top>Calc.Low", "n.asm": "start>low", "o.tf": "vm.box>size, ip>vm.box", "p.gd": "Foe._ready>Foe.low", "q.ex": "Calc.top>Calc.low", "r.zig": "main>low",
    "s.jl": "Geo.top>Geo.low", "t.pas": "Shapes.TDot.Draw>Shapes.Low", "u.erl": "calc.top>calc.low",
}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("owners")
    for name, text in FILES.items():
        (root / name).write_text(text)
    g = analyze(spark, str(root))
    assert validate.violations(g).count() == 0
    nodes = {r.id: r for r in g.nodes.collect()}
    return nodes, [(r.relation_type, nodes[r.source_id], nodes[r.target_id], r.resolution_status) for r in g.edges.collect()]


@pytest.mark.parametrize("file", sorted(FILES))
def test_names_carry_their_owners(graph, file):
    nodes, edges = graph
    mine = [n for n in nodes.values() if n.file == file and n.kind != "module"]
    assert sorted(f"{n.kind} {n.qualified_name.removeprefix(file + '.')}" for n in mine) == sorted(NODES[file].split(", "))
    inside = {(a.qualified_name, b.qualified_name) for r, a, b, s in edges if r == "contains" and b.file == file}
    assert len(inside) == len(mine) and all(a == file or b.startswith(a) or file == "t.pas" for a, b in inside)


@pytest.mark.parametrize("file", sorted(CALLS))
def test_calls_inside_a_file(graph, file):
    _, edges = graph
    bare = lambda n: n.qualified_name.removeprefix(file + ".")
    found = {f"{bare(a)}>{bare(b)}" for r, a, b, s in edges if r in ("calls", "references") and s == "resolved" and a.file == file}
    assert found == set(CALLS[file].split(", ")) - {""}
