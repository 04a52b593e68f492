"""Settings, languages by content, build conditions, compile commands and class paths."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from skein.sources import builds as B
from skein.sources import config as C


def test_settings_round_trip_and_refuse(tmp_path):
    path = tmp_path / "s.toml"
    path.write_text('[analysis]\nlanguage = "web"\nlanguages = ["css", "html"]\nmax_file_bytes = 10\n[analysis.context]\ngo_tags = ["x"]\nrust_all_cfg = false\n')
    s = C.read_settings(str(path))
    assert s.include == ["**/*.css", "**/*.html", "**/*.htm"] and s.scan_config().max_bytes == 10
    path.write_text(s.to_toml())
    assert C.read_settings(str(path)) == s and C.read_settings(None) == C.Settings()
    for bad in ('language = "cobold"', 'languages = ["python", "python"]', 'language = "web"\nlanguages = ["java"]', "unknown = 1", "max_file_bytes = true", 'exclude = [""]', "[context]\nx = 1", "[context]\ngo_tags = 1", 'language = "mixed"\nlanguages = ["web"]'):
        path.write_text(bad)
        with pytest.raises(ValueError):
            C.read_settings(str(path))


def test_languages_by_content(spark):
    assert C.languages_of("c-family") == ("c", "cpp") and C.languages_of("go") == ("go",)
    rows = [("a.h", "cpp", b"class X {};"), ("b.h", "cpp", b"int f(void);"), ("c.m", "objectivec", b"@interface A\n@end"), ("d.m", "objectivec", b"function y = f(x)"), ("e.py", "python", b"class X")]
    df = spark.createDataFrame(rows, "path string, language string, content binary")
    got = lambda *sel: [r[0] for r in df.orderBy("path").select(C.refined_language(F.col("path"), F.col("language"), F.col("content"), list(sel))).collect()]
    assert got("c", "cpp", "objectivec", "matlab") == ["cpp", "c", "objectivec", "matlab", "python"]
    assert got("c", "matlab") == ["c", "c", None, "matlab", "python"]


@pytest.mark.parametrize(
    ("path", "text", "takes"),
    [
        ("a.go", "", True), ("a_windows.go", "", False), ("a_linux_amd64.go", "", True), ("a_arm64.go", "", False), ("a.go", "//go:build linux && !cgo", True), ("a.go", "//go:build (windows || x) && linux", True),
        ("a.go", "//go:build windows", False), ("a.go", "//go:build linux &&", True), ("a.go", "//go:build a b", True), ("a.go", "// +build windows\n", False), ("a.go", "// +build linux,!cgo darwin\n// +build x", True), ("a.go", "//go:build unix", True),
    ],
)
def test_go_builds(path, text, takes):
    build = B.GoBuild(("x",), "linux", "amd64")
    assert B.go_takes(path, text, build) == takes and B.go_takes(path, text, B.GoBuild())


@pytest.mark.parametrize(
    ("cfg", "takes"),
    [
        ('feature = "a"', True), ('feature = "b"', False), ("unix", True), ("windows", False), ("test", True), ("not(test)", True), ('all(unix, feature = "b")', False), ('any(windows, feature = "b")', False), ("any(windows, test)", True),
        ('not(any(windows, not(unix)))', True), ('not(target_os = "linux")', False), ('all(not(feature = "a"), test)', False), ("all(", True), ('target_pointer_width = "32"', False), ("all()", True), ("any()", False),
    ],
)
def test_rust_conditions(cfg, takes):
    build = B.RustBuild(("a",), "x86_64-unknown-linux-gnu", False)
    assert B.rust_condition(cfg, build) == takes and B.rust_condition(cfg, B.RustBuild())


def test_module_names(spark):
    assert B.go_module("// x\nmodule example.org/a/b\n\ngo 1.22\n") == "example.org/a/b" and B.go_module("") is None
    assert B.crate_name('[package]\nname = "my-crate"\n', "/x/y") == "my_crate" and B.crate_name("no toml [", "/x/a-b/") == "a_b"
    df = spark.createDataFrame([("a_windows.go", ""), ("b.rs", "")], "path string, text string")
    assert [r[0] for r in df.select(B.in_build(F.col("path"), F.col("text"), B.GoBuild(system="linux"))).collect()] == [False, True]


def test_compile_commands(spark, tmp_path):
    entries = [
        {"file": "a.c", "directory": "/src", "command": 'cc -Iinc -isystem "/sys dir" -DX=1 -std=c11 -D Y a.c'}, {"file": "/b.c", "arguments": ["cl", "/I", "x", "/DZ", "/std:c17", "b.c"]}, {"directory": "/src"}, {"file": "c.c"},
    ]
    (tmp_path / "compile_commands.json").write_text(json.dumps(entries))
    got = {r.file: (r.include_dirs, r.defines, r.standard) for r in B.compile_commands(spark, str(tmp_path / "compile_commands.json")).collect()}
    assert got == {"/src/a.c": (["/src/inc", "/sys dir"], ["X=1", "Y"], "c11"), "/b.c": (["./x"], ["Z"], "c17")}


def test_class_path(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.jar", "w") as z:
        z.writestr("org/x/Foo.class", b"")
        z.writestr("module-info.class", b"")
        z.writestr("../evil.class", b"")
        z.writestr("org/x/Src.java", "package org.x; class Src { int run(int a) { return 1; } }")
    (tmp_path / "bad.jar").write_bytes(b"no archive")
    index = B.type_index(spark, [str(tmp_path)])
    rows = index.collect()
    assert {(r.type, r.method) for r in rows if r.type} == {("org.x.Foo", None), ("org.x.Src", None), ("org.x.Src", "run")}
    assert sorted(r.problem.split(":")[0] for r in rows if r.problem) == ["unreadable archive", "unsafe member"]
    names = spark.createDataFrame([("org.x.Foo",), ("Foo",), ("other.Src",), ("Nope",)], "name string")
    assert {r.name for r in B.known_types(names, index).collect()} == {"org.x.Foo", "Foo", "other.Src"}
    calls = spark.createDataFrame([("Src", "run"), ("a.b.Src", "run"), ("Foo", "run")], "owner string, method string")
    assert {r.owner for r in B.known_methods(calls, index).collect()} == {"Src", "a.b.Src"}
    assert B.type_index(spark, []).count() == 0
