"""Targets counted by key, against every pair of a reference and a definition."""

from __future__ import annotations


import pytest
from pyspark.sql import functions as F

from skein.operators import resolve
from skein.plans.typed import type_names


def most_joined(df) -> int:
    """The most rows that a join of the plan has made."""
    df.collect()
    graph, todo, most = df._jdf.queryExecution().executedPlan(), [], 0
    todo.append(graph)
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if "Join" in name and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        kids = [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in name else [p.children().apply(i) for i in range(p.children().size())]
        todo += kids
    return most


@pytest.fixture
def cascade_rows(spark):
    names = F.when(F.col("id") % 3 == 0, F.array(F.lit("a.x"), F.lit("b.y"))).when(F.col("id") % 3 == 1, F.array(F.lit("a.x"), F.lit("c.z"))).otherwise(F.array(F.lit("n.q"), F.lit("none")))
    refs = spark.range(300).select(F.col("id").alias("ref"), names.alias("names"))
    d = lambda name, a, b: spark.range(a, b).select(F.lit(name).alias("name"), F.col("id").alias("target"))
    return refs, d("a.x", 0, 200).union(d("b.y", 100, 300)).union(d("c.z", 500, 501)).union(d("m.q", 7, 9)).union(d("a.x", 0, 5))


def test_cascade_counts_shared_targets_once(spark, cascade_rows):
    out = resolve.cascade(*cascade_rows)
    got = {r.ref: (r.candidates, r.target_id, r.status, r.how) for r in out.collect()}
    assert got == {k: [(300, None, "unresolved", "name"), (201, None, "unresolved", "name"), (2, None, "unresolved", "short name")][k % 3] for k in range(300)}
    assert most_joined(out) <= 2000  # every pair would be 40,000


def test_cascade_null_and_repeated(spark):
    refs = spark.createDataFrame([(1, ["a", "b"]), (1, ["a", "b"]), (2, ["n", None]), (3, ["p.n"]), (4, ["b", "b"]), (5, None), (None, ["a"])], "ref int, names array<string>")
    defs = spark.createDataFrame([("a", 8), ("b", 8), ("b", 8), ("n", None)], "name string, target int")
    got = sorted(map(tuple, resolve.cascade(refs, defs).collect()), key=str)
    assert got == sorted([(1, 1, 8, "resolved", "name")] * 2 + [(2, 0, None, "external", "name"), (3, 0, None, "external", "short name"), (4, 1, 8, "resolved", "name"), (5, 0, None, "external", None), (None, 0, None, "external", None)], key=str)


def test_type_names_of_two_packages(spark):
    asked = spark.range(300).select(F.lit("go").alias("language"), F.format_string("f%d", "id").alias("file"), F.lit("T").alias("name"))
    of = lambda p, a, b: spark.range(a, b).select(F.lit("go").alias("language"), F.format_string("o%d", "id").alias("file"), F.lit(p).alias("package"), F.lit("T").alias("name"), F.lit(f"{p}.T").alias("qualified"), F.format_string("t%d", "id").alias("target"))
    types = of("p", 0, 200).union(of("q", 100, 300))
    packages = asked.select("language", "file", F.explode(F.array(F.lit("p"), F.lit("q"))).alias("package")).where("file <> 'f9'")
    imports = spark.createDataFrame([("go", "f1", "q.T", None), ("go", "f1", "p.T", None), ("go", "f2", "p.T", "Other")], "language string, file string, path string, local string")
    out = type_names(asked, types, imports, packages.union(packages))
    got = {r.file: (r.candidates, r.status, r.how) for r in out.collect()}
    assert got == {f"f{k}": (300, "unresolved", {1: "import", 9: "name"}.get(k, "package")) for k in range(300)}
    assert most_joined(out) <= 2000  # every pair would be 60,000
