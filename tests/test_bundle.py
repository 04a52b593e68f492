"""Bundles: split, read, check and search."""

from __future__ import annotations

import json

import pytest

from skein.operators import search, validate
from skein.sources import bundle as B
from skein.sources import publish
from skein.sources.graph import synthetic


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    graph = synthetic(spark, 120, 3)
    folder = str(tmp_path_factory.mktemp("bundles") / "one")
    return graph, B.write(graph, folder, {"nodes": 50, "edges": 70, "records": 40, "postings": 30, "groups": 5})


def test_round_trip_and_counts(spark, made):
    graph, bundle = made
    assert bundle.index["counts"]["nodes"] == 120 and len(bundle.index["chunks"]["nodes"]) == 3
    back = bundle.graph()
    key = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert key(back.nodes.select(graph.nodes.columns)) == key(graph.nodes) and key(back.edges.select(graph.edges.columns)) == key(graph.edges)
    ordered = [r.id for r in bundle.table("nodes").orderBy("ordinal").collect()]
    assert ordered == sorted(ordered)
    assert B.violations(spark, bundle.folder).count() == 0 and validate.violations(graph).count() == 0


@pytest.mark.parametrize("query", ["m1.f", "SRC/M0", "n11", " n1 ", "zzz", "", "ﬁ"])
def test_search_equals_search_of_the_graph(made, query):
    graph, bundle = made
    want = [r.id for r in search.search(graph.nodes, query, 7).collect()]
    assert [r.id for r in B.search_bundle(bundle, query, 7).collect()] == want
    with pytest.raises(B.BundleError):
        B.search_bundle(bundle, "x", 0)


def test_detail_and_representative(made):
    graph, bundle = made
    nodes, edges = B.module_detail(bundle, "n1")
    own = {r.id for r in graph.nodes.collect() if r.file == "src/m1.py"}
    assert {r.id for r in nodes.collect()} == own
    assert {r.id for r in edges.collect()} == {r.id for r in graph.edges.collect() if r.source_id in own or r.target_id in own}
    group = bundle.table("groups").first()
    found = B.representative(bundle, group.group_id)
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(chunk" in plan and f"= {group.representative_edge_chunk})" in plan
    seen, cursor = [], 0
    while cursor is not None:
        page, cursor = B.neighbourhood_page(bundle, "n1", cursor, 1)
        seen += [r.group_id for r in page.collect()]
    node = {r.ordinal: r.id for r in bundle.table("nodes").collect()}
    assert len(seen) == len(set(seen)) and set(seen) == {r.group_id for r in bundle.table("groups").collect() if "n1" in (node.get(r.source_ordinal), node.get(r.target_ordinal))}
    with pytest.raises(B.BundleError):
        B.module_detail(bundle, "nowhere")


@pytest.mark.parametrize("phase", ["begin", "staged", "retire", "place", "placed"])
def test_a_writer_stopped_at_any_phase(spark, tmp_path, monkeypatch, phase):
    folder = str(tmp_path / "b")
    for k in range(2):
        (tmp_path / ("b" if not k else "b2")).mkdir()
    (tmp_path / "b" / "old").write_text("old")
    journal = publish.Journal(spark, folder)
    note = publish.Journal._note

    def stops(self, at, told):
        note(self, at, told)
        if at == phase:
            raise KeyboardInterrupt

    monkeypatch.setattr(publish.Journal, "_note", stops)
    with pytest.raises(KeyboardInterrupt):
        told = journal.begin()
        staged = tmp_path / told["staged"].rsplit("/", 1)[-1]
        staged.mkdir()
        (staged / "new").write_text("new")
        journal.finish(told)
    with pytest.raises(publish.PublishError):
        publish.Journal(spark, folder).begin()
    monkeypatch.setattr(publish.Journal, "_note", note)
    assert publish.recover(spark, folder) == ("undone" if phase == "begin" else "done")
    assert [p.name for p in (tmp_path / "b").iterdir() if not p.name.startswith(".")] == ["old" if phase == "begin" else "new"]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["b", "b2"] and publish.recover(spark, folder) is None


def test_damage_is_found(spark, made, tmp_path):
    graph, _ = made
    folder = str(tmp_path / "b")
    bundle = B.write(graph, folder, full=False)
    with pytest.raises(B.BundleError):
        B.write(graph, folder)
    B.write(synthetic(spark, 60, 2), folder, force=True, full=False)
    assert B.read(spark, folder).index["counts"]["nodes"] == 60 and bundle.index["counts"]["nodes"] == 120
    index = json.loads((tmp_path / "b" / "index.json").read_text())
    index["chunks"]["edges"][0]["sha256"] = "0"
    (tmp_path / "b" / "index.json").write_text(json.dumps(index))
    (tmp_path / "b" / ".index.json.crc").unlink(missing_ok=True)
    assert {r.rule for r in B.violations(spark, folder).collect()} == {"chunks of edges differ from the index"}
    index["chunks"]["nodes"].append({"chunk": 99, "count": 1, "sha256": "0"})
    (tmp_path / "b" / "index.json").write_text(json.dumps(index))
    with pytest.raises(B.BundleError):
        B.quick_check(spark, folder)
    (tmp_path / "b" / "index.json").unlink()
    with pytest.raises(B.BundleError):
        B.read(spark, folder)
