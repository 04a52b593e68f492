"""Rules of inference, code patterns, display and aggregates, on small tables against results by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from skein.functions import blocks as B
from skein.functions import code_text as C
from skein.functions import display as D
from skein.functions import extract as X
from skein.operators import infer, packages, rollup
from skein.sources.graph import synthetic


def test_block_ends():
    def end(code, start, after, how=B.Style()):  # noqa: B008
        return code[start : B.Blocks(code, how).end(start, after)]

    brace = "void f() { if (x) { y(); } }\nint z;"
    assert end(brace, 0, 8).endswith("} }") and end("f() }", 0, 3) == "f() " and end("f() {", 0, 3) == "f() {"
    assert end("void f(); void g() { }", 0, 8) == "void f();" and end("f(a, {b: 1}) { c; }", 0, 12) == "f(a, {b: 1}) { c; }"
    assert end("fun f() = g()\nfun h() { }", 0, 7) == "fun f() = g()"
    words = "sub a\n x\nEnd Sub\nb"
    assert end(words, 0, 5, X._BASIC) == "sub a\n x\nEnd Sub"
    nested = "function a\n if x\n end\nend\nb"
    assert end(nested, 0, 10, X._JULIA) == "function a\n if x\n end\nend"
    assert end("def a\n  x if y\n  while z do\n  end\nend\nb", 0, 5, X._RUBY).endswith("end\nend")
    assert end("def f(x), do: x\ndef g do\nend", 0, 8, X._ELIXIR) == "def f(x), do: x"
    assert end("module m\nsubroutine s\nif (x) then\nend if\nend\nend module m\nb", 9, 21, X._FORTRAN).endswith("end if\nend")
    indent = "def a:\n  x\n\n  y\nb"
    assert end(indent, 0, 5, X._INDENT) == "def a:\n  x\n\n  y"


def test_returns():
    assert [B.returns(x) for x in ("x", "return 1; return;", "return x\n", "RETURN\n}", "f() { return }")] == ["no_explicit_return", "mixed", "returns_value", "returns_none", "returns_none"]


def test_routines(spark):
    rows = [
        ("CREATE FUNCTION f AS $b$ SELECT 1 FROM t $b$", " SELECT 1 FROM t ", "unknown"), ("create function g as 'return 1'", "return 1", "unknown"),
        ("CREATE TRIGGER x BEFORE INSERT OR UPDATE ON t BEGIN return; END", " return; ", "BEFORE INSERT OR UPDATE"), ("nothing", "", "unknown"),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, s string")
    got = df.orderBy("i").select(C.routine_body(F.col("s")), C.trigger_event(F.col("s"))).collect()
    assert [tuple(g) for g in got] == [r[1:] for r in rows]
    body = "INSERT INTO a.x SELECT * FROM b JOIN c -- FROM no\n /* FROM no2 */ WHERE v = 'FROM no3'; DELETE FROM d; UPDATE e SET q = 1"
    tables = spark.createDataFrame([(body,)], "s string").select(C.routine_tables(F.col("s"))).first()[0]
    assert {tuple(t) for t in tables} == {("a.x", "writes"), ("d", "writes"), ("e", "writes"), ("b", "reads"), ("c", "reads")}
    says = [("x", "no_explicit_return"), ("return 1; return;", "mixed"), ("return x\n", "returns_value"), ("RETURN\n}", "returns_none")]
    assert [r[0] for r in spark.createDataFrame(says, "s string, w string").select(C.return_behavior(F.col("s"))).collect()] == [w for _, w in says]
    types = [("Map<String, List<int>>[]", "Map"), ("a" + "<b" * 12 + ">" * 12, "a"), ("A.B<C>", "A.B"), ("x?", "x"), ("T...", "T")]
    assert [r[0] for r in spark.createDataFrame(types, "s string, w string").select(C.without_generics(F.col("s"))).collect()] == [w for _, w in types]
    assert spark.sql("select timestamp '2024-02-29 12:00:01' t").select(C.utc_text(F.col("t"))).first()[0] == "2024-02-29T12:00:01Z"


def test_uses():
    assert C.rust_uses("pub(crate) use a::{self, b::{c as d, *}, e};") == [("a", "a", False), ("a::b::c", "d", False), ("a::b", "", True), ("a::e", "e", False)]
    assert C.rust_uses("use x::y as z;") == [("x::y", "z", False)] and C.rust_uses("use p::*;") == [("p", "", True)] and C.rust_uses("use ;") == []
    assert C.php_uses(r"use A\B\{C, D as E};") == [("class", r"A\B\C", "C"), ("class", r"A\B\D", "E")]
    assert C.php_uses(r"use function \a\f, b\g as h;") == [("function", r"a\f", "f"), ("function", r"b\g", "h")] and C.php_uses("x") == []


def test_receivers_members_and_results(spark):
    calls = spark.createDataFrame([(1, "m", "C", "x"), (2, "m", "C", "f"), (3, "m", "C", "D"), (4, "m", "C", "q"), (5, "m", "C", "this"), (6, "m", "C", "y")], "ref int, caller string, caller_owner string, receiver string")
    variables = spark.createDataFrame([("m", "x", "A"), ("C", "x", "B"), ("C", "f", "B"), ("m", "y", "A"), ("m", "y", "B")], "scope string, name string, type string")
    types = spark.createDataFrame([("D",)], "name string")
    got = {r.ref: (r.owner, r.how) for r in infer.receiver_types(calls, variables, types).collect()}
    assert got == {1: ("A", "variable"), 2: ("B", "field"), 3: ("D", "type"), 4: (None, "unknown"), 5: ("C", "own"), 6: (None, "unknown")}
    asked = spark.createDataFrame([(1, "A", "run", 0), (2, "A", "run", 1), (3, None, "run", 0), (4, "B", "go", 0), (5, "B", "no", 0)], "ref int, owner string, name string, arity int")
    parents = spark.createDataFrame([("A", "P"), ("P", "A"), ("B", "P")], "child string, parent string")
    members = spark.createDataFrame([("A", "run", 0, "a.run"), ("P", "run", 0, "p.run"), ("P", "run", 1, "p.run1"), ("P", "go", 0, "p.go"), ("P", "go", 0, "p.go2")], "owner string, name string, arity int, target string")
    got = {r.ref: (r.target_id, r.status) for r in infer.member_calls(asked, parents, members).collect()}
    assert got == {1: ("a.run", "resolved"), 2: ("p.run1", "resolved"), 3: (None, "unresolved"), 4: (None, "unresolved"), 5: (None, "external")}
    assert {r.ref: r.status for r in infer.member_calls(asked, parents, members, nearest=False).collect()}[1] == "unresolved"
    made = spark.createDataFrame([(1, "k"), (2, "f"), (3, "g"), (4, "h")], "ref int, target_id string")
    defs = spark.createDataFrame([("k", "class", None, "m"), ("f", "function", "'K'", "m"), ("g", "function", "K | None", "m"), ("h", "method", "Gone", "m")], "id string, kind string, returns string, module string")
    known = spark.createDataFrame([("m", "K", "k")], "module string, name string, id string")
    assert {(r.ref, r.type_id, r.evidence) for r in infer.call_results(made, defs, known).collect()} == {(1, "k", "constructor"), (2, "k", "return annotation")}


def test_names(spark):
    refs = spark.createDataFrame([(1, "pascal", "FOO"), (2, "lua", "FOO"), (3, "lua", "two"), (4, "lua", "one")], "ref int, language string, name string")
    defs = spark.createDataFrame([("pascal", "Foo", "p"), ("lua", "foo", "l"), ("lua", "two", "a"), ("lua", "two", "b"), ("lua", "one", "c"), ("lua", "one", "c")], "language string, name string, target string")
    assert {r.ref: (r.target_id, r.status) for r in infer.global_names(refs, defs).collect()} == {1: ("p", "resolved"), 2: (None, "unresolved"), 3: (None, "unresolved"), 4: ("c", "resolved")}
    refs = spark.createDataFrame([(1, "f", "a", None), (2, "f", "b", "m.b"), (3, "f", "c", None), (4, "f", "d", None), (5, "f", "e", None)], "ref int, file string, name string, qualified string")
    imports = spark.createDataFrame([("f", "a", "i")], "file string, name string, target string")
    defs = spark.createDataFrame([("x", "f", "a", "f.a", 1), ("y", "g", "b", "m.b", 1), ("z1", "f", "c", "f.c", 1), ("z2", "f", "c", "f.c", 9), ("w", "g", "d", "g.d", 1), ("e1", "g", "e", "g.e", 1), ("e2", "h", "e", "h.e", 1)], "target string, file string, name string, qualified string, start int")
    got = {r.ref: (r.target_id, r.how) for r in infer.symbol_cascade(refs, imports, defs).collect()}
    assert got == {1: ("i", "import"), 2: ("y", "qualified"), 3: ("z2", "file"), 4: ("w", "name"), 5: (None, None)}
    impls = spark.createDataFrame([(1, "S"), (2, "T"), (3, "U")], "ref int, self_type string")
    types = spark.createDataFrame([("S", "id-s"), ("T", "t1"), ("T", "t2")], "name string, target string")
    assert {r.ref: r.owner for r in infer.impl_owners(impls, types).collect()} == {1: "id-s", 2: "T", 3: "U"}
    paths = spark.createDataFrame([(1, "crate::a", "self::x"), (2, "crate::a", "super::y"), (3, "crate::a", "q::z"), (4, "crate::a", "c1::z"), (5, "crate", "super::k")], "ref int, module string, path string")
    aliases = spark.createDataFrame([("crate::a", "q", "r::s"), ("crate::a", "r", "crate::t"), ("crate::a", "c1", "c2"), ("crate::a", "c2", "c1")], "module string, local string, path string")
    got = {r.ref: r.real for r in infer.real_paths(paths, aliases).collect()}
    assert {k: got[k] for k in (1, 2, 3, 5)} == {1: "crate::a::x", 2: "crate::y", 3: "crate::t::s::z", 5: "crate::k"} and got[4] in ("c1::z", "c2::z")


def js_hash(text):
    h = 2166136261
    units = text.encode("utf-16-le")
    for k in range(0, len(units), 2):
        h = ((h ^ int.from_bytes(units[k : k + 2], "little")) * 16777619) % 2**32
    return h


def test_hash_layout_and_labels(spark):
    texts = ["", "a", "python:x.py:f", "é日本", "🎉x"]
    assert [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(D.fnv1a(F.col("t"))).collect()] == [js_hash(t) for t in texts]
    nodes = synthetic(spark, 60, 1).nodes
    modules = rollup.node_modules(nodes)
    over = spark.createDataFrame([("n5", -1.0, -2.0)], "id string, x double, y double")
    at = {r.id: (r.x, r.y) for r in D.positions(nodes, modules, over).collect()}
    assert len(at) == 60 and at["n0"] == (0.0, 0.0) and at["n1"] == (820.0, 0.0) and at["n5"] == (-1.0, -2.0)
    kids = sorted(r.id for r in nodes.where("parent_id = 'n1'").collect())
    k = kids.index("n9")
    turn, radius = math.radians(js_hash("n9") % 360), 150 + k % 5 * 34
    assert at["n9"] == pytest.approx((820 + math.cos(turn) * radius + k % 4 * 45, math.sin(turn) * radius + k // 4 * 45))
    rows = [("module", "src/very/long/path/of/a/module.py", "d", "q", "i"), ("class", "f", "", "q", "i"), ("class", "f", None, "", "i"), ("class", "f", "a name that is longer than the limit", "q", "i")]
    df = spark.createDataFrame(rows, "kind string, file string, d string, q string, i string").withColumn("l", D.label(*map(F.col, ("kind", "file", "d", "q", "i"))))
    got = [tuple(r) for r in df.select("l", D.compact_label(F.col("kind"), F.col("l"), 12)).collect()]
    assert got == [(rows[0][1], "…f/a/module.py"[-12:] if False else "…" + rows[0][1][-11:]), ("q", "q"), ("i", "i"), (rows[3][2], "a name that…")]
    spans = spark.sql("select named_struct('start_line', 1, 'start_col', 2, 'end_line', 3, 'end_col', 4) s union all select null")
    assert {r[0] for r in spans.select(D.span_text(F.col("s"))).collect()} == {"1:2–3:4", ""}


def test_languages_and_hits(spark):
    rows = [('{"language": "go"}', "c", "x"), ("{}", "c", "x"), (None, "", "x"), (None, None, None)]
    df = spark.createDataFrame(rows, "e string, l string, x string")
    said = lambda doc: [r[0] for r in df.select(D.language_of(F.col("e"), F.col("l"), F.col("x"), doc)).collect()]
    assert said("java") == ["go", "c", "x", "java"] and said("mixed")[3] is None
    edges = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 0.0), ("b", 0.0, 5.0, 10.0, 5.0), ("c", 3.0, 3.0, 3.0, 3.0)], "id string, x1 double, y1 double, x2 double, y2 double")
    assert D.hit_edge(edges, 5.0, 1.0).first().id == "a" and D.hit_edge(edges, 3.0, 3.4).first().id == "c" and D.hit_edge(edges, 50.0, 50.0).isEmpty()
    nodes = spark.createDataFrame([("a", 0.0, 0.0, 20.0, 10.0, 1), ("b", 5.0, 0.0, 20.0, 10.0, 2)], "id string, x double, y double, width double, height double, drawn int")
    assert D.hit_node(nodes, 4.0, 0.0).first().id == "b" and D.hit_node(nodes, -13.0, 0.0).first().id == "a" and D.hit_node(nodes, 99.0, 0.0).isEmpty()


def test_packages_and_completeness(spark):
    files = spark.createDataFrame([("d/a.go", "d", "p", "x/d"), ("d/b.go", "d", "p", "x/d"), ("d/a_test.go", "d", "p_test", "x/d"), ("e/m.go", "e", "main", "x/e"), ("e/z.go", "e", "zed", "x/e"), ("g/t.go", "g", "g_test", "x/g")], "path string, folder string, package string, base string")
    got = {(r.folder, r.package): (r.import_path, r.n_files) for r in packages.go_packages(files).collect()}
    assert got == {("d", "p"): ("x/d", 2), ("d", "p_test"): ("x/d#p_test", 1), ("e", "main"): ("x/e", 1), ("e", "zed"): ("x/e#zed", 1), ("g", "g_test"): ("x/g", 1)}
    told = spark.createDataFrame([("p", "b"), ("p", "a"), ("p", "a"), ("p", ""), ("q", None)], "k string, v string")
    assert {tuple(r) for r in packages.merged_texts(told, "k", "v").collect()} == {("p", "a;b"), ("q", "")}
    g = synthetic(spark, 40, 2)
    assert packages.same_sets(g.nodes.select("id"), g.nodes.select("id").union(g.nodes.select("id"))) and not packages.same_sets(g.nodes.select("id"), g.nodes.select("id").limit(3))
    assert packages.definition_counts(g.nodes).agg(F.sum("n")).first()[0] == 40
    assert packages.relation_counts(g.edges, g.nodes).agg(F.sum("n")).first()[0] == g.edges.where("resolution_status = 'resolved'").count()
    made = spark.createDataFrame([("f", "class", 1, 0)], "file string, kind string, line int, col int")
    assert [(r.side, r.n) for r in packages.coverage(made, g.nodes).collect()] == [("missing", 1)]
    assert packages.with_default_language(g.nodes.withColumn("language", F.lit(None).cast("string")), "python").where("language = 'python'").count() == 40
