"""Checks of a graph as queries: every violation is a row, and a valid graph has none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.sources import schema as S
from skein.sources.graph import Graph
from skein.sources.shared import written


def _found(df: DataFrame, rule: str, bad: Column, what: str = "id") -> DataFrame:
    return df.where(bad).select(F.lit(rule).alias("rule"), F.col(what).alias("item"))


def bad_span(span: str) -> Column:
    s = F.col(span)
    return s.isNotNull() & ((s.start_line < 1) | (s.end_line < 1) | (s.start_col < 0) | (s.end_col < 0) | s.start_line.isNull() | s.start_col.isNull() | s.end_line.isNull() | s.end_col.isNull())


def _outside(col: str, values: tuple[str, ...], optional: bool = False) -> Column:
    known = F.col(col).isin(*values)
    return F.col(col).isNotNull() & ~known if optional else ~F.coalesce(known, F.lit(False))


def _blank(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit("")) == ""


def duplicates(df: DataFrame, rule: str) -> DataFrame:
    return df.groupBy("id").count().where("count > 1").select(F.lit(rule).alias("rule"), F.col("id").alias("item"))


def dangling(rows: DataFrame, key: str, nodes: DataFrame, rule: str, what: str = "id") -> DataFrame:
    """(rule, item) of rows whose key is no node's id. The nodes' ids are hashed and the rows stream past them, so that no task sorts the rows."""
    known = nodes.select(F.col("id").alias("_known")).distinct().hint("shuffle_hash")
    return rows.where(F.col(key).isNotNull()).join(known, F.col(key) == F.col("_known"), "left_anti").select(F.lit(rule).alias("rule"), F.col(what).alias("item"))


def on_parent_cycles(nodes: DataFrame) -> DataFrame:
    """(id,) of nodes whose chain of parents never ends.

    Only nodes that are parents are followed; the others end as their parents do. Pointers double every round, so
    chains of any length take a logarithmic number of joins; each round is written to the shared folder, which keeps
    plans small. A chain that ends after more steps than the pointers reach has a node that just reaches so far, so
    once a round loses no row, what is left is on a cycle or leads to one. The joins are merges: written pointers take
    few bytes and many rows, and would be broadcast by those bytes.
    """
    every = written(nodes.where("parent_id is not null and id is not null").select("id", F.col("parent_id").alias("up")).dropDuplicates(["id"]))
    now = written(every.join(every.select(F.col("up").alias("id")).distinct().hint("merge"), "id", "left_semi"))
    before, left = None, now.count()
    while left and left != before:
        far = now.select(F.col("id").alias("up"), F.col("up").alias("_next"))
        now = written(now.join(far.hint("merge"), "up").select("id", F.col("_next").alias("up")))
        before, left = left, now.count()
    return every.join(now.select(F.col("id").alias("up")).hint("merge"), "up", "left_semi").select("id")


def violations(graph: Graph) -> DataFrame:
    """(rule, item) for every rule of the contract that a row breaks."""
    n, e, d = graph.nodes, graph.edges, graph.diagnostics
    parts = [
        _found(n, "node.id is empty", _blank("id")),
        duplicates(n, "node.id is duplicate"),
        _found(n, "node.kind is unknown", _outside("kind", S.NODE_KINDS)),
        _found(n, "node.qualified_name is empty", _blank("qualified_name")),
        _found(n, "node.visibility is unknown", _outside("visibility", S.VISIBILITIES)),
        _found(n, "node.return_behavior is unknown", _outside("return_behavior", S.RETURN_BEHAVIORS, True)),
        _found(n, "node.execution_kind is unknown", _outside("execution_kind", S.EXECUTION_KINDS, True)),
        _found(n, "node.span is out of range", bad_span("span")),
        _found(n, "node.language is empty", F.col("language") == ""),
        _found(n, "node.return_sites has an unknown value_kind", F.exists(F.coalesce("return_sites", F.array().cast(S.NODES["return_sites"].dataType)), lambda x: ~F.coalesce(x.value_kind.isin("value", "none"), F.lit(False)))),
        dangling(n, "parent_id", n, "node.parent_id does not exist"),
        on_parent_cycles(n).select(F.lit("node.parent_id is on a cycle").alias("rule"), F.col("id").alias("item")),
        _found(e, "edge.id is empty", _blank("id")),
        duplicates(e, "edge.id is duplicate"),
        dangling(e, "source_id", n, "edge.source_id does not exist"),
        dangling(e, "target_id", n, "edge.target_id does not exist"),
        _found(e, "edge.relation_type is empty", F.trim(F.coalesce("relation_type", F.lit(""))) == ""),
        _found(e, "edge.resolution_status is unknown", _outside("resolution_status", S.RESOLUTION_STATUSES)),
        _found(e, "edge.provenance is unknown", _outside("provenance", S.PROVENANCES)),
        _found(e, "edge.confidence is not in 0 to 1", ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))),
        _found(e, "edge.source_span is out of range", bad_span("source_span")),
        _found(e, "edge.detail is missing", F.col("detail").isNull()),
        _found(d, "diagnostic.code is empty", _blank("code"), "message"),
        _found(d, "diagnostic.message is empty", _blank("message"), "code"),
        _found(d, "diagnostic.severity is unknown", _outside("severity", S.SEVERITIES), "code"),
        _found(d, "diagnostic.span is out of range", bad_span("span"), "code"),
    ]
    return reduce(DataFrame.unionByName, parts)
