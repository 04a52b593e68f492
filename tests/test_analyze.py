"""From source files to graphs."""

from __future__ import annotations

import pytest

from skein.functions.extract import PROFILES, masked, profile_records, python_records
from skein.operators import validate
from skein.plans.analyze import analyze
from skein.sources.files import ScanConfig, scan

FILES = {
    "pkg/__init__.py": "from .base import Base\n",
    "pkg/base.py": "import os\n\nclass Base:\n    def run(self):\n        return self.help()\n\n    def help(self):\n        return os.getcwd()\n",
    "pkg/service.py": "from pkg.base import Base\nfrom . import base as b\nimport importlib\n\n\ndef make(x):\n    def make_inner():\n        yield 1\n    return Base()\n\n\nclass Service(Base):\n    async def go(self):\n        make(1)\n        b.Base()\n        missing()\n        importlib.import_module('pkg.base')\n\n\ndef shadow(make):\n    make()\n",
    "broken.py": "def (:\n",
    "tests/test_x.py": "x = 1\n",
    "gen/generated/y.py": "y = 1\n",
    "node_modules/z.js": "function z() {}\n",
    "web/app.js": "import {a} from './lib';\n// function no() {}\nfunction yes() { helper('function no2() {}'); }\nclass K {}\n",
    "notes.txt": "nothing",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def test_scan_prunes_and_tells_why(spark, tree):
    got = {r.path: (r.language, r.reason) for r in scan(spark, tree).select("path", "language", "reason").collect()}
    assert got["pkg/base.py"] == ("python", None) and got["tests/test_x.py"][1] == "tests_excluded" and got["gen/generated/y.py"][1] == "generated"
    assert "node_modules/z.js" not in got and "notes.txt" not in got
    tiny = {r.path: r.reason for r in scan(spark, tree, ["python"], ScanConfig(max_bytes=10)).select("path", "reason").collect()}
    assert tiny["pkg/base.py"] == "file_too_large" and "web/app.js" not in tiny


def test_python_graph(spark, tree):
    g = analyze(spark, tree, ["python"])
    assert validate.violations(g).count() == 0
    name = {r.id: r.qualified_name for r in g.nodes.collect()}
    edges = {(r.relation_type, name[r.source_id], name[r.target_id], r.resolution_status) for r in g.edges.collect()}
    assert {
        ("contains", "pkg.base", "pkg.base.Base", "resolved"), ("inherits", "pkg.service.Service", "pkg.base.Base", "resolved"), ("calls", "pkg.base.Base.run", "pkg.base.Base.help", "resolved"),
        ("calls", "pkg.service.Service.go", "pkg.service.make", "resolved"), ("calls", "pkg.service.Service.go", "pkg.base.Base", "resolved"), ("calls", "pkg.service.Service.go", "missing", "unresolved"),
        ("calls", "pkg.service.shadow", "make", "unresolved"), ("imports", "pkg.service", "pkg.base", "resolved"), ("imports", "pkg.service", "pkg.base.Base", "resolved"), ("imports", "pkg", "pkg.base.Base", "resolved"),
        ("dynamic_imports", "pkg.service.Service.go", "pkg.base", "resolved"), ("calls", "pkg.service.make", "pkg.base.Base", "resolved"),
    } <= edges
    node = {r.qualified_name: r for r in g.nodes.collect()}
    assert (node["pkg.service.make"].kind, node["pkg.base.Base.run"].kind) == ("function", "method")
    assert node["pkg.service.make"].return_behavior == "returns_value" and node["pkg.service.make.<locals>.make_inner"].execution_kind == "generator" and node["pkg.service.Service.go"].execution_kind == "async"
    codes = {(r.code, r.file) for r in g.diagnostics.collect()}
    assert ("parse_error", "broken.py") in codes and ("excluded_file", "tests/test_x.py") in codes and ("generated_file", "gen/generated/y.py") in codes


def test_chains_of_any_length(spark, tmp_path):
    depth = 8
    body = "".join(f"{'    ' * i}class C{i}:\n" for i in range(depth)) + "    " * depth + "def run():\n" + "    " * (depth + 1) + "pass\n"
    chain = ".".join(f"C{i}" for i in range(depth))
    (tmp_path / "deep.py").write_text(f"{body}\n\ndef go():\n    {chain}.run()\n    {chain}.walk()\n    C0.C2.C3.C4.C5.run()\n")
    g = analyze(spark, str(tmp_path), ["python"])
    name = {r.id: r.qualified_name for r in g.nodes.collect()}
    calls = {(name[r.target_id], r.resolution_status) for r in g.edges.where("relation_type = 'calls'").collect()}
    assert calls == {(f"deep.{chain}.run", "resolved"), (f"{chain}.walk", "unresolved"), ("C0.C2.C3.C4.C5.run", "unresolved")}
    assert g.diagnostics.where("code = 'unresolved_call'").count() == 2


def test_results_of_calls(spark, tmp_path):
    (tmp_path / "shapes.py").write_text(
        "class Dot:\n    def draw(self): pass\n    def near(self) -> 'Dot': return self\n    def box(self) -> Box: return Box()\n\n"
        "class Box:\n    def fill(self): pass\n\ndef make() -> Dot: return Dot()\ndef vague(): return 1\n"
    )
    (tmp_path / "use.py").write_text(
        "import shapes\nfrom shapes import Dot, make\n\n"
        "def a():\n    d = make()\n    e = d.near()\n    f = e.box()\n    f.fill()\n    d.gone()\n\n"
        "def b(x: Dot, y: 'shapes.Box', z):\n    x.draw()\n    y.fill()\n    z.draw()\n    make().near().draw()\n    shapes.make().draw()\n\n"
        "def c():\n    d = Dot()\n    d = 3\n    d.draw()\n    g = shapes.vague()\n    g.draw()\n    h: Dot = None\n    h.draw()\n\n"
        "def loop():\n    p = q.near()\n    q = p.near()\n    q.draw()\n"
    )
    g = analyze(spark, str(tmp_path), ["python"])
    assert validate.violations(g).count() == 0
    name = {r.id: r.qualified_name for r in g.nodes.collect()}
    got = {(name[r.source_id].split(".")[-1], name[r.target_id].removeprefix("shapes."), r.resolution_status) for r in g.edges.where("relation_type = 'calls'").collect() if name[r.source_id].startswith("use.")}
    assert got == {
        ("a", "make", "resolved"), ("a", "Dot.near", "resolved"), ("a", "Dot.box", "resolved"), ("a", "Box.fill", "resolved"), ("a", "d.gone", "unresolved"),
        ("b", "Dot.draw", "resolved"), ("b", "Box.fill", "resolved"), ("b", "z.draw", "unresolved"), ("b", "make", "resolved"), ("b", "Dot.near", "resolved"), ("b", "make().near().draw", "unresolved"),
        ("c", "Dot", "resolved"), ("c", "d.draw", "unresolved"), ("c", "vague", "resolved"), ("c", "g.draw", "unresolved"), ("c", "Dot.draw", "resolved"),
        ("loop", "q.near", "unresolved"), ("loop", "p.near", "unresolved"), ("loop", "q.draw", "unresolved"),
    }


def test_graphs_do_not_depend_on_partitions(spark, tree):
    a = analyze(spark, tree, ["python", "javascript"])
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    b = analyze(spark, tree, ["python", "javascript"])
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(a.nodes) == rows(b.nodes) and rows(a.edges) == rows(b.edges)
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_profiles_ignore_comments_and_strings():
    rows = profile_records("web/app.js", FILES["web/app.js"].encode(), "javascript")
    assert [(r["kind"], r["name"]) for r in rows if r["record"] == "node"] == [("module", "app.js"), ("function", "yes"), ("class", "K")]
    assert [r["name"] for r in rows if r["record"] == "import"] == ["./lib"]
    assert [r["chain"] for r in rows if r["record"] == "ref"] == [["helper"]]


SAMPLES = {
    "go": ("package p\nimport \"fmt\"\ntype T struct {}\nfunc (t T) Run() { fmt.Println() }\n", {"T", "Run"}), "rust": ("use a::b;\nstruct S;\nimpl S { fn go(&self) {} }\n", {"S", "go"}),
    "java": ("import a.B;\npublic class A { public int f(int x) { return g(x); } }\n", {"A", "f"}), "ruby": ("require 'x'\nclass A\n  def ok?\n  end\nend\n", {"A", "ok?"}), "kotlin": ("import a.b\nclass K\nfun f(x: Int) = x\n", {"K", "f"}),
    "swift": ("import F\nprotocol P {}\nfunc g() {}\n", {"P", "g"}), "shell": ("source ./l.sh\nrun() {\n  x\n}\n", {"run"}), "lua": ("-- function no()\nfunction m.f() end\n", {"m.f"}), "elixir": ("defmodule A.B do\n  def f(x), do: x\nend\n", {"A.B", "f"}),
    "c": ("#include <a.h>\nint f(int x) {\n return g(x);\n}\n", {"f"}), "php": ("<?php use A\\B; class C { function m() {} }", {"C", "m"}), "scala": ("import a.b\ntrait T { def f = 1 }\n", {"T", "f"}), "haskell": ("import Data.Map\nf :: Int -> Int\ndata D = D\n", {"f", "D"}),
}


@pytest.mark.parametrize("lang", sorted(SAMPLES))
def test_profiles_find_names(lang):
    text, names = SAMPLES[lang]
    rows = profile_records("x", text.encode(), lang)
    assert names <= {r["name"] for r in rows if r["record"] == "node"}


@pytest.mark.parametrize("lang", sorted(PROFILES))
def test_masks_keep_offsets(lang):
    text = "a \"b\\\"c\" 'd' # e\n// f /* g\n*/ -- h\n`i` {- j -} ! k"
    out = masked(text, PROFILES[lang])
    assert len(out) == len(text) and [i for i, c in enumerate(out) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]


def test_python_cases():
    assert python_records("a.py", b"")[0]["kind"] == "module"
    assert python_records("a.py", b"# -*- coding: latin-1 -*-\nx = '\xe9'\n")[0]["record"] == "node"
    assert python_records("a.py", b"\xff\xfe")[0]["record"] == "problem"
    twice = [r["id"] for r in python_records("a.py", b"def f(): pass\ndef f(): pass\n") if r["record"] == "node"]
    assert twice[1:] == ["python:a.py:a.f:function", "python:a.py:a.f:function~1"]
