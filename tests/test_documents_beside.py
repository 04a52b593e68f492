"""Overlays, layouts, the registry and Git probes."""

from __future__ import annotations

import copy
import json
import subprocess

import pytest

from skein.operators import validate
from skein.sources import documents as D
from skein.sources.graph import synthetic

OVERLAY = {
    "format": D.OVERLAY_FORMAT, "schema_version": "1.0", "analysis_schema_version": "1.0", "analysis_sha256": "a" * 64,
    "nodes": [{"id": "manual:n", "label": "By hand", "kind": "external"}],
    "edges": [{"id": "manual:e", "source_id": "n1", "target_id": "manual:n", "relation_type": "uses", "resolution_status": "external", "confidence": 1, "source_span": None, "detail": {"why": "x"}}],
    "annotations": [{"id": "manual:a", "kind": "note", "text": "see", "node_id": "manual:n", "position": {"x": 1, "y": 2.5}}],
}


def test_overlay_merges_and_refuses(spark, tmp_path):
    base = synthetic(spark, 50, 2)
    (tmp_path / "o.json").write_text(json.dumps(OVERLAY))
    document, tables = D.read_overlay(spark, str(tmp_path / "o.json"))
    assert D.overlay_violations(base, tables).count() == 0
    out = D.merge_overlay(base, document, tables, "a" * 64)
    assert out.meta["counts"]["nodes"] == 51 and out.meta["extensions"]["manual_overlay"]["annotations"] == OVERLAY["annotations"]
    assert validate.violations(out).count() == 0 and out.edges.where("id = 'manual:e'").first().provenance == "manual"
    with pytest.raises(D.DocumentError):
        D.merge_overlay(base, document, tables, "b" * 64)
    assert D.merge_overlay(base, document, tables, "b" * 64, ignore_digest=True).nodes.count() == 51
    bad = copy.deepcopy(OVERLAY)
    bad["nodes"].append({"id": "n1", "label": "", "kind": "class"})
    bad["edges"].append(bad["edges"][0] | {"id": "manual:f", "target_id": "nowhere", "confidence": 2, "resolution_status": "x", "relation_type": " "})
    bad["annotations"] += [{"id": "manual:a", "kind": "x", "text": "", "node_id": "gone", "edge_id": "manual:e"}]
    rules = {r.rule for r in D.overlay_violations(base, D.overlay_tables(spark, bad)).collect()}
    assert {
        "id lacks the prefix manual:", "id is taken", "label is empty", "kind must be external or unknown", "end does not exist", "confidence is not in 0 to 1", "resolution_status is unknown", "relation_type is empty",
        "id is duplicate", "kind must be note, label or group", "text is empty", "an annotation points at a node or an edge, not both", "annotation's node does not exist",
    } <= rules
    for change in ({"format": "x"}, {"schema_version": "2"}, {"analysis_sha256": "zz"}, {"nodes": None}, {"edges": [{"id": "manual:e"}]}):
        with pytest.raises(D.DocumentError):
            D.overlay_tables(spark, OVERLAY | change)


def test_layouts(spark, tmp_path):
    good = {"format": D.LAYOUT_FORMAT, "schema_version": "1.0", "camera": {"x": 0, "y": 1.5, "zoom": 2}, "nodes": {"a": {"x": 1, "y": 2}}, "annotations": []}
    (tmp_path / "l.json").write_text(json.dumps(good))
    assert [tuple(r) for r in D.positions(spark, D.read_layout(str(tmp_path / "l.json"))).collect()] == [("a", 1.0, 2.0)]
    for change in ({"format": "x"}, {"camera": {"x": 0, "y": 0, "zoom": 0}}, {"nodes": {"": {"x": 0, "y": 0}}}, {"nodes": {"a": {"x": True, "y": 0}}}, {"annotations": {}}, {"analysis_schema_version": "9"}):
        with pytest.raises(D.DocumentError):
            D.check_layout(good | change)
    with pytest.raises(D.DocumentError):
        D.read_layout(str(tmp_path / "none.json"))


def test_registry(tmp_path):
    old = {"format": D.REGISTRY_FORMAT, "repositories": [{"repository_id": "r1", "display_name": "R", "absolute_path": "/x/r", "data_path": "data/r1", "analysis_path": "data/r1/a.json"}]}
    (tmp_path / "r.json").write_text(json.dumps(old))
    registry = D.read_registry(str(tmp_path / "r.json"))
    (record,) = registry["repositories"]
    assert record["analysis_path"] == "repositories/r1/a.json" and record["layout_path"] == "repositories/r1/layout.json" and record["validation_status"] == "pending" and registry["schema_version"] == "1.1"
    D.write_registry(str(tmp_path / "r.json"), registry)
    assert D.read_registry(str(tmp_path / "r.json")) == registry and D.migrated(registry) == (registry, False)
    for change in ({"bundle_path": "repositories/r2/b"}, {"data_path": "../x"}, {"storage_mode": "cloud"}, {"validation_status": "x"}, {"git_remote": 1}, {"display_name": ""}):
        with pytest.raises(D.DocumentError):
            D.check_record(record | change)
    with pytest.raises(D.DocumentError):
        D.migrated(old | {"repositories": [old["repositories"][0] | {"analysis_path": "data/r1/../../x"}]})
    a, b = record | {"git_remote": "o1"}, record | {"normalized_path": "/y", "git_remote": "o2"}
    assert D.matching_record([a, b], "/x/r", "o1") is a and D.matching_record([a, b], "/x/r", "o2") is b and D.matching_record([a, b], "/z", "o1") is a
    assert D.matching_record([a, b, b], "/z", "o2") is None and D.matching_record([a, b], "/x/r", None) is a and D.matching_record([a], "/z", None) is None


def test_git_probes(tmp_path):
    assert D.git_commit(str(tmp_path)) is None and D.git_origin(str(tmp_path)) is None
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q")
    git("remote", "add", "origin", "https://example.org/r.git")
    git("commit", "-q", "--allow-empty", "-m", "x")
    assert D.git_commit(str(tmp_path)) == git("rev-parse", "HEAD") and D.git_origin(str(tmp_path)) == "https://example.org/r.git"
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / ".git").write_text("gitdir: ../.git\n")
    assert D.git_origin(str(tmp_path / "tree")) == "https://example.org/r.git"
