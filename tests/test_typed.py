"""Calls and inheritance across files of languages other than Python."""

from __future__ import annotations

import re

import pytest

from skein.operators import validate
from skein.plans.analyze import analyze

FILES = {
    "a/Base.java": "package a;\npublic class Base {\n  protected void help(int x) { }\n  void help(int x, int y) { }\n  void twice() { }\n}\n",
    "a/Foo.java": "package a;\nimport java.util.List;\npublic class Foo extends Base implements Runnable {\n  private Tool tool = new Tool();\n  public void run() { help(1); help(1, 2); tool.cut(this); this.run(); other.go(); Tool.make(); twice(); missing(); }\n}\n",
    "a/Tool.java": "package a;\npublic class Tool {\n  void cut(Object o) { }\n  static Tool make() { return new Tool(); }\n  void twice() { }\n}\n",
    "g/t.go": 'package g\n\ntype T struct{ n int }\n\nfunc (t *T) Run(a int, b int) { t.Stop(); fmt.Println("x") }\nfunc (t T) Stop() {}\n',
    "g/m.go": "package g\n\nfunc main() { v := T{}; v.Run(1, 2); helper() }\nfunc helper() {}\n",
    "w/a.ts": "import { B } from './b';\nexport class A extends B {\n  go(x: number) { this.base(); make(x); }\n}\nfunction unused() { nowhere(); }\n",
    "w/b.ts": "export class B {\n  base() { return 1; }\n}\nexport function make(x: number) { return x; }\n",
    "r/l.rs": "trait Shape: Solid { fn area(&self) -> f64; }\nstruct Sq { a: f64 }\nimpl Shape for Sq { fn area(&self) -> f64 { self.side() } }\nimpl Sq { fn side(&self) -> f64 { self.a } }\n",
    "c/x.cpp": "class Q : public P { };\nint f(int a) { return g(a) + q.h(); }\nint g(int a) { return a; }\n",
    "p/a.php": "<?php\nclass Kid extends Par { function x() { $o = new Par(); $o->y(1); strlen('a'); } }\nclass Par { function y($a) { } }\n",
}


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("typed")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    g = analyze(spark, str(root))
    assert validate.violations(g).count() == 0
    name = {r.id: r.qualified_name for r in g.nodes.collect()}
    shown = lambda q: re.split(r"::|[.]", q.split("(")[0])[-1]
    return {(r.relation_type, shown(name[r.source_id]), name[r.target_id], r.resolution_status) for r in g.edges.collect()}


@pytest.mark.parametrize(
    "edge",
    [
        ("inherits", "Foo", "a.Base", "resolved"), ("inherits", "Foo", "Runnable", "external"), ("calls", "run", "a.Base.help(1)", "resolved"), ("calls", "run", "a.Tool.cut(1)", "resolved"), ("calls", "run", "a.Foo.run(0)", "resolved"),
        ("calls", "run", "other.go", "unresolved"), ("calls", "run", "a.Tool.make(0)", "resolved"), ("calls", "run", "a.Base.twice(0)", "resolved"), ("calls", "run", "missing", "external"), ("calls", "Foo", "a.Tool", "resolved"),
        ("calls", "Run", "g.T.Stop(0)", "resolved"), ("calls", "main", "g.T.Run(2)", "resolved"), ("calls", "main", "g.helper(0)", "resolved"), ("calls", "Run", "fmt.Println", "unresolved"),
        ("inherits", "A", "w/b.ts.B", "resolved"), ("calls", "go", "w/b.ts.B.base", "resolved"), ("calls", "go", "w/b.ts.make", "resolved"), ("calls", "unused", "nowhere", "unresolved"),
        ("inherits", "Shape", "Solid", "external"), ("inherits", "Sq", "crate::r::l::Shape", "resolved"), ("calls", "area", "crate::r::l::Sq::side(0)", "resolved"),
        ("inherits", "Q", "P", "external"), ("calls", "f", "c/x.cpp.g", "resolved"), ("calls", "f", "q.h", "unresolved"),
        ("inherits", "Kid", "p/a.php.Par", "resolved"), ("calls", "x", "p/a.php.Par.y", "resolved"), ("calls", "x", "strlen", "external"),
    ],
)
def test_edge(edges, edge):
    assert edge in edges, sorted(x for x in edges if x[0] == edge[0] and x[1] == edge[1])


PACKAGES = {
    "one/Tool.java": "package one;\npublic class Tool { public void cut() { } }\n",
    "two/Tool.java": "package two;\npublic class Tool { public void cut() { } protected void dull() { } }\n",
    "two/Near.java": "package two;\npublic class Near { private Tool tool; void run() { tool.cut(); } }\n",
    "three/Far.java": "package three;\nimport one.Tool;\npublic class Far extends Tool { public Far(int a) { cut(); } void go(Tool t) { t.cut(); } }\n",
    "three/All.java": "package three;\nimport two.*;\ninterface All { void put(Tool t); }\n",
    "three/Lost.java": "package three;\nenum Lost { A; void go(Tool t) { t.cut(); } }\n",
    "x/Cs.cs": "using T = Deep.Er.Thing;\nnamespace Top {\n  public class Cs { internal void Go(T t) { t.Do(1); } }\n}\n",
    "x/Thing.cs": "namespace Deep.Er;\npublic class Thing { public void Do(int a) { } }\n",
}


def test_types_by_packages_and_imports(spark, tmp_path):
    for name, text in PACKAGES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    g = analyze(spark, str(tmp_path))
    assert validate.violations(g).count() == 0
    nodes = {r.id: r for r in g.nodes.collect()}
    name = {k: r.qualified_name for k, r in nodes.items()}
    edges = {(r.relation_type, name[r.source_id], name[r.target_id], r.resolution_status) for r in g.edges.collect()}
    assert {
        ("calls", "two.Near.run(0)", "two.Tool.cut(0)", "resolved"), ("uses", "two.Near", "two.Tool", "resolved"), ("inherits", "three.Far", "one.Tool", "resolved"), ("calls", "three.Far.<init>(1)", "one.Tool.cut(0)", "resolved"),
        ("calls", "three.Far.go(1)", "one.Tool.cut(0)", "resolved"), ("uses", "three.All.put(1)", "two.Tool", "resolved"), ("uses", "three.Lost.go(1)", "Tool", "unresolved"), ("calls", "three.Lost.go(1)", "t.cut", "unresolved"),
        ("contains", "three", "three.Far", "resolved"), ("calls", "Top.Cs.Go(1)", "Deep.Er.Thing.Do(1)", "resolved"), ("uses", "Top.Cs.Go(1)", "Deep.Er.Thing", "resolved"),
    } <= edges
    # an import of one.Tool has an external node of that name besides
    kinds = {r.qualified_name: (r.kind, r.visibility) for r in nodes.values() if r.file}
    assert kinds["one.Tool"] == ("class", "public") and kinds["two.Tool.dull(0)"] == ("method", "private") and kinds["three.All"][0] == "interface" and kinds["three.Lost"][0] == "type" and kinds["three"][0] == "namespace"
