"""Set operations on graphs: union with a conflict check, overlays, multiset differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.graph import Graph, conform
from skein.sources.schema import EDGES, NODES


def conflicts(rows: DataFrame) -> DataFrame:
    """(id,) of ids that stand for different rows."""
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    return rows.groupBy("id").agg(F.min(F.xxhash64(whole)).alias("a"), F.max(F.xxhash64(whole)).alias("b")).where("a <> b").select("id")


def union(graphs: list[Graph]) -> Graph:
    """Nodes and edges once each, diagnostics all. An id that stands for different rows is an error."""
    nodes, edges, diagnostics = graphs[0].nodes, graphs[0].edges, graphs[0].diagnostics
    for g in graphs[1:]:
        nodes, edges, diagnostics = nodes.unionByName(g.nodes), edges.unionByName(g.edges), diagnostics.unionByName(g.diagnostics)
    for what, rows in (("node", nodes), ("edge", edges)):
        if found := conflicts(rows).limit(5).collect():
            raise ValueError(f"{what} ids stand for different rows: {', '.join(sorted(r.id for r in found))}")
    return Graph(nodes.dropDuplicates(["id"]), edges.dropDuplicates(["id"]), diagnostics, graphs[0].meta)


def overlay_nodes(rows: DataFrame) -> DataFrame:
    """Hand-made nodes (id, label, kind) as graph nodes."""
    return conform(rows.select("id", "kind", F.col("label").alias("qualified_name"), F.col("label").alias("display_name"), F.lit("unknown").alias("visibility")), NODES)


def overlay_edges(rows: DataFrame) -> DataFrame:
    return conform(rows.withColumn("provenance", F.lit("manual")), EDGES)


def overlay_violations(base: Graph, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, item): ids without the manual: prefix, ids taken, unknown kinds, ends that don't exist."""
    both = nodes.select("id").union(edges.select("id"))
    known = base.nodes.select("id").union(nodes.select("id"))
    end = edges.select("id", F.explode(F.array("source_id", "target_id")).alias("end"))
    parts = [
        both.where(~F.col("id").startswith("manual:")).select(F.lit("id lacks the prefix manual:").alias("rule"), F.col("id").alias("item")),
        both.join(base.nodes.select("id").union(base.edges.select("id")), "id", "left_semi").select(F.lit("id is taken"), "id"),
        both.groupBy("id").count().where("count > 1").select(F.lit("id is duplicate"), "id"),
        nodes.where(~F.col("kind").isin("external", "unknown")).select(F.lit("kind must be external or unknown"), "id"),
        end.join(known.withColumnRenamed("id", "end"), "end", "left_anti").select(F.lit("end does not exist"), "id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def merge_overlay(base: Graph, nodes: DataFrame, edges: DataFrame) -> Graph:
    return Graph(base.nodes.unionByName(overlay_nodes(nodes)), base.edges.unionByName(overlay_edges(edges)), base.diagnostics, base.meta)


def difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of one multiset that the other lacks, with `side` (missing or extra) and `n`.

    Signed counts are combined before one shuffle; no join.
    """
    cols = expected.columns
    signed = expected.withColumn("_sign", F.lit(1)).unionByName(actual.select(*cols).withColumn("_sign", F.lit(-1)))
    left = signed.groupBy(*cols).agg(F.sum("_sign").alias("_n")).where("_n <> 0")
    return left.withColumns({"side": F.when(F.col("_n") > 0, "missing").otherwise("extra"), "n": F.abs("_n")}).drop("_n")
