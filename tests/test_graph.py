"""Operators of the graph engine on a small graph, and invariants on generated ones."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from skein.operators import merge, report, resolve, rollup, search, validate
from skein.sources import graph as G
from skein.sources.schema import DIAGNOSTICS, EDGES, NODES

SPAN = (1, 0, 2, 4)


def small(spark):
    nodes = [
        ("m1", "module", "a", "src/a.py", None, "python"), ("m2", "module", "b", "src/b.py", None, "python"), ("f1", "function", "a.main", "src/a.py", "m1", "python"), ("f2", "function", "b.run", None, "c1", "python"),
        ("c1", "class", "b.Straße", None, "m2", "python"), ("x1", "external", "os", None, None, "python"), ("u1", "unknown", "?", None, None, None),
    ]
    edges = [("e1", "f1", "f2", "calls", "resolved", 0.9), ("e2", "f1", "f2", "calls", "resolved", 0.2), ("e3", "f1", "x1", "calls", "external", 0.7), ("e4", "f2", "u1", "calls", "unresolved", 0.2), ("e5", "f2", "c1", "calls", "resolved", 1.0)]
    n = spark.createDataFrame(nodes, "id string, kind string, qualified_name string, file string, parent_id string, language string").withColumns({"visibility": F.lit("public"), "display_name": F.col("qualified_name")})
    e = spark.createDataFrame(edges, "id string, source_id string, target_id string, relation_type string, resolution_status string, confidence double").withColumns({"provenance": F.lit("ast"), "detail": F.lit("{}")})
    d = spark.createDataFrame([("parse_error", "error", "bad", "x.py"), ("note", "info", "n", None)], "code string, severity string, message string, file string")
    return G.Graph(G.conform(n, NODES), G.conform(e, EDGES), G.conform(d, DIAGNOSTICS))


def test_a_valid_graph_has_no_violations(spark):
    assert validate.violations(small(spark)).count() == 0


def test_violations_are_named(spark):
    g = small(spark)
    g.nodes = g.nodes.withColumn("kind", F.when(F.col("id") == "u1", "odd").otherwise(F.col("kind"))).withColumn("parent_id", F.when(F.col("id") == "m2", "f2").when(F.col("id") == "x1", "gone").otherwise(F.col("parent_id")))
    g.edges = g.edges.withColumn("confidence", F.when(F.col("id") == "e1", 1.5).otherwise(F.col("confidence"))).union(g.edges.where("id = 'e2'")).withColumn("target_id", F.when(F.col("id") == "e3", "nowhere").otherwise(F.col("target_id")))
    got = {(r.rule, r.item) for r in validate.violations(g).collect()}
    assert got == {
        ("node.kind is unknown", "u1"), ("node.parent_id does not exist", "x1"), ("node.parent_id is on a cycle", "m2"), ("node.parent_id is on a cycle", "f2"), ("node.parent_id is on a cycle", "c1"),
        ("edge.confidence is not in 0 to 1", "e1"), ("edge.id is duplicate", "e2"), ("edge.target_id does not exist", "e3"),
    }


def test_modules_and_groups(spark):
    g = small(spark)
    where = {r.id: (r.module_id, r.found_by) for r in rollup.node_modules(g.nodes).collect()}
    assert where["f1"] == ("m1", "file") and where["f2"] == ("m2", "parent") and where["x1"][1] == where["u1"][1] == "virtual" and where["x1"][0] != where["u1"][0]
    groups = rollup.edge_groups(rollup.with_modules(g.edges, rollup.node_modules(g.nodes))).collect()
    both = next(r for r in groups if (r.source_module, r.target_module) == ("m1", "m2"))
    assert (both["count"], both.min_confidence, both.max_confidence, both.representative_edge_id) == (2, 0.2, 0.9, "e1")
    assert len(groups) == 3


def test_report(spark):
    g = small(spark)
    r = report.rates(g).first()
    assert (r.nodes, r.edges, r.unresolved_or_unsupported_edge_rate, r.parse_error_file_count) == (7, 5, 0.2, 1)
    assert {(x.facet, x.value): x.n for x in report.counts(g).collect()}["edges_by_resolution", "resolved"] == 3
    none = G.Graph(g.nodes.limit(0), g.edges.limit(0), g.diagnostics.limit(0))
    assert report.rates(none).first().unresolved_or_unsupported_edge_rate == 0.0


def test_search_normalises_and_limits(spark):
    g = small(spark)
    ids = lambda q, **k: [r.id for r in search.search(g.nodes, q, **k).collect()]
    assert ids("MAIN") == ["f1"] and ids("  ") == [] and ids("straße") == ["c1"] and ids("ＭＡＩＮ") == ["f1"]
    assert ids("a", limit=2) == ["c1", "f1"] and ids("b", languages=["go"]) == []
    with pytest.raises(ValueError):
        search.search(g.nodes, "a", limit=0)
    page = search.search_page(g.nodes, "a", 2).collect()
    assert len(page) == 2 and page[0].truncated


def test_ordinals_match_a_global_sort(spark):
    df = spark.range(1000).select(F.sha1(F.col("id").cast("string")).alias("id"))
    got = {r.id: (r.ordinal, r.chunk) for r in rollup.chunked(df, 64).collect()}
    assert got == {k: (i, i // 64) for i, k in enumerate(sorted(got))}


def test_difference_is_a_multiset_difference(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (3,)], "x int")
    b = spark.createDataFrame([(1,), (3,), (4,), (4,)], "x int")
    assert sorted(tuple(r) for r in merge.difference(a, b).select("x", "side", "n").collect()) == [(1, "missing", 1), (2, "missing", 1), (4, "extra", 2)]


def test_union_and_overlay(spark):
    g = small(spark)
    both = merge.union([g, g])
    assert (both.nodes.count(), both.edges.count(), both.diagnostics.count()) == (7, 5, 4)
    assert merge.conflicts(g.nodes.union(g.nodes.where("id = 'f1'").withColumn("kind", F.lit("class")))).collect()[0].id == "f1"
    hand = spark.createDataFrame([("manual:n", "N", "external"), ("f1", "F", "class")], "id string, label string, kind string")
    lines = spark.createDataFrame([("manual:e", "f1", "manual:n", "uses", "external", 0.5), ("manual:f", "f1", "zzz", "uses", "external", 0.5)], "id string, source_id string, target_id string, relation_type string, resolution_status string, confidence double")
    assert {r.rule for r in merge.overlay_violations(g, hand, lines).collect()} == {"id lacks the prefix manual:", "id is taken", "kind must be external or unknown", "end does not exist"}
    assert merge.merge_overlay(g, hand, lines).edges.where("provenance = 'manual'").count() == 2


def test_json_round_trip(spark, tmp_path):
    g = small(spark)
    g.nodes = g.nodes.withColumn("span", F.when(F.col("id") == "f1", F.struct(*[F.lit(x).alias(n) for x, n in zip(SPAN, ("start_line", "start_col", "end_line", "end_col"), strict=True)]))).withColumn("extensions", F.to_json(F.struct("language")))
    path = str(tmp_path / "g.json")
    digest = G.write_json(g, path, {"language": "python"})
    assert digest == G.canonical_digest(json.loads(open(path).read()))
    again = G.read_json(spark, path)
    assert again.meta == {"language": "python"}
    assert merge.difference(again.nodes.select("id", "kind", "file", "parent_id", "language", F.to_json("span").alias("s")), g.nodes.select("id", "kind", "file", "parent_id", "language", F.to_json("span").alias("s"))).count() == 0
    assert again.edges.count() == 5 and validate.violations(again).count() == 0


def test_synthetic_graph_is_valid_and_stable(spark):
    a, b = G.synthetic(spark, 300), G.synthetic(spark, 300)
    assert validate.violations(a).count() == 0
    assert merge.difference(a.edges.select("id"), b.edges.repartition(7).select("id")).count() == 0
    assert a.edges.where("relation_type = 'contains'").count() == 300 - 12


def test_lexical_shadowing(spark):
    scopes = spark.createDataFrame([("m", None), ("f", "m"), ("g", "f")], "id string, parent_id string")
    bound = spark.createDataFrame([("m", "x", "X", False), ("f", "x", None, False), ("m", "y", "Y", False), ("m", "y", "imported", True)], "scope string, name string, target string, is_import boolean")
    refs = spark.createDataFrame([(1, "g", "x"), (2, "m", "x"), (3, "g", "y"), (4, "g", "z")], "ref int, scope string, name string")
    got = {r.ref: (r.target_id, r.status) for r in resolve.lexical(refs, scopes, bound).collect()}
    assert got == {1: (None, "unresolved"), 2: ("X", "resolved"), 3: ("Y", "resolved"), 4: (None, "unbound")}


def test_ordinals_hold_whatever_columns_are_read(spark):
    """Enough rows that the bounds of the ranges come from a sample of them."""
    df = spark.range(60_000).select(F.sha1(F.col("id").cast("string")).alias("id"), F.lit("x").alias("other"))
    got = rollup.with_ordinals(df)
    ids = sorted(r.id for r in df.collect())
    assert [r.ordinal for r in got.select("id", "ordinal").orderBy("id").collect()] == list(range(len(ids)))
    assert [r.id for r in got.orderBy("ordinal").collect()] == ids
