"""Command line: python -m skein COMMAND. What goes wrong is told on the standard error, with exit code 2."""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from pyspark.sql import SparkSession

from skein.operators import report, search, validate
from skein.plans.analyze import analyze
from skein.sources import bundle, config, documents
from skein.sources.graph import Graph, canonical_digest, read_json, write_json


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skein")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, **options: Any) -> None:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for o, v in options.items():
            o = "--" + o.replace("_", "-")
            c.add_argument(o, action="store_true") if v is bool else c.add_argument(o, type=type(v) if v is not None else str, default=v)

    command("analyze", "root", "output", config=None, languages=None, commit_sha=None, deterministic=bool)
    command("validate", "analysis")
    command("validate-manual", "manual", "analysis")
    command("merge", "analysis", "manual", "output", ignore_analysis_hash=bool)
    command("split", "analysis", "output", node_chunk_size=2000, edge_chunk_size=5000, diagnostic_chunk_size=2000, search_chunk_size=5000, force=bool)
    command("validate-bundle", "bundle", quick=bool)
    command("search", "input", "query", limit=search.LIMIT)
    command("report", "analysis", output=None)
    return p


def _valid(graph: Graph) -> Graph:
    if first := validate.violations(graph).first():
        raise ValueError(f"{first.rule}: {first.item}")
    return graph


def _loaded(spark: SparkSession, path: str) -> tuple[Graph, str]:
    with open(path, encoding="utf-8") as f:
        document = json.load(f)
    return _valid(read_json(spark, path)), canonical_digest(document)


def summary(graph: Graph) -> dict[str, Any]:
    """The report's counts and rates as one object."""
    out: dict[str, Any] = {}
    for r in report.counts(graph).orderBy("facet", "value").collect():  # a row for each kind, relation, status, code and severity
        out.setdefault(r.facet, {})[r.value] = r.n
    return out | report.rates(graph).first().asDict()


def run(spark: SparkSession, argv: list[str]) -> int:
    a = _parser().parse_args(argv)
    if a.command == "analyze":
        settings = config.read_settings(a.config)
        chosen = a.languages.split(",") if a.languages else list(config.languages_of(settings.language, settings.languages))
        graph = _valid(analyze(spark, a.root, chosen, settings.scan_config()))
        meta = {"languages": chosen, "commit_sha": a.commit_sha or documents.git_commit(a.root), "generated_at": None if a.deterministic else documents.datetime.now(documents.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")}
        print(write_json(graph, a.output, meta))
    elif a.command == "validate":
        _loaded(spark, a.analysis)
        print("valid")
    elif a.command == "validate-manual":
        graph, _ = _loaded(spark, a.analysis)
        if first := documents.overlay_violations(graph, documents.read_overlay(spark, a.manual)[1]).first():
            raise ValueError(f"{first.rule}: {first.item}")
        print("valid")
    elif a.command == "merge":
        graph, digest = _loaded(spark, a.analysis)
        document, tables = documents.read_overlay(spark, a.manual)
        merged = _valid(documents.merge_overlay(graph, document, tables, digest, a.ignore_analysis_hash))
        print(write_json(merged, a.output, merged.meta))
    elif a.command == "split":
        graph, _ = _loaded(spark, a.analysis)
        sizes = {"nodes": a.node_chunk_size, "records": a.node_chunk_size, "edges": a.edge_chunk_size, "diagnostics": a.diagnostic_chunk_size, "postings": a.search_chunk_size}
        print(json.dumps(bundle.write(graph, a.output, sizes, a.force).index["counts"], sort_keys=True))
    elif a.command == "validate-bundle":
        bundle.quick_check(spark, a.bundle)
        if not a.quick and (first := bundle.violations(spark, a.bundle).first()):
            raise ValueError(f"{first.rule}: {first.item}")
        print("valid")
    elif a.command == "search":
        if a.input.endswith(".json"):
            found = search.search(_loaded(spark, a.input)[0].nodes, a.query, a.limit)
        else:
            found = bundle.search_bundle(bundle.read(spark, a.input), a.query, a.limit)
        for r in found.select("id", "kind", "qualified_name", "display_name", "file").collect():  # `limit` rows
            print(json.dumps(r.asDict(), ensure_ascii=False))
    else:
        told = summary(_loaded(spark, a.analysis)[0])
        documents.write_json(a.output, told) if a.output else print(json.dumps(told, sort_keys=True, indent=2))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    try:
        return run(spark or SparkSession.builder.appName("skein").getOrCreate(), argv)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
