"""Counts and rates of a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.graph import Graph


def counts_by(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(facet, value, n) for each column in one pass over df: rows are combined per value of every column before the shuffle."""
    facets = F.array(*[F.struct(F.lit(name).alias("facet"), F.col(c).alias("value")) for name, c in columns.items()])
    return df.select(F.explode(facets).alias("x")).groupBy(F.col("x.facet").alias("facet"), F.col("x.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def counts(graph: Graph) -> DataFrame:
    parts = [
        counts_by(graph.nodes, {"nodes_by_kind": "kind"}),
        counts_by(graph.edges, {"edges_by_relation": "relation_type", "edges_by_resolution": "resolution_status", "edges_by_provenance": "provenance"}),
        counts_by(graph.diagnostics, {"diagnostics_by_code": "code", "diagnostics_by_severity": "severity"}),
    ]
    return reduce(DataFrame.unionByName, parts)


def rates(graph: Graph) -> DataFrame:
    """One row of totals and rates; a rate over nothing is 0."""
    n = graph.nodes.agg(F.count(F.lit(1)).alias("nodes"))
    e = graph.edges.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum(F.col("resolution_status").isin("unresolved", "unsupported").cast("long")), F.lit(0)).alias("open"))
    failed = (F.col("code") == "parse_error") & (F.col("file") != "")
    d = graph.diagnostics.agg(F.count(F.lit(1)).alias("diagnostics"), F.count_distinct(F.when(failed, F.col("file"))).alias("parse_error_file_count"))
    share = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    one = n.crossJoin(e).crossJoin(d)  # three tables of one row
    return one.select("nodes", "edges", "diagnostics", share("open", "edges").alias("unresolved_or_unsupported_edge_rate"), share("diagnostics", "nodes").alias("diagnostics_per_node"), "parse_error_file_count")


def percentiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The nearest-rank p50, p95 and p99 of a value, and the largest."""
    rank = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{value}`)")
    return rows.groupBy(by).agg(rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"), F.max(value).alias("top"))


def summary(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """The least, most, first and last of a value in an order."""
    return rows.groupBy(by).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
