"""Distributed connected components: hooking and pointer doubling over an edge table.

Every node hooks onto its smallest neighbour if that is smaller than itself, which makes trees; pointers
double until they reach the roots; edges are renamed to the roots, and what still joins two of them goes
into the next round. A round moves each edge twice and each node a few times, whatever the size of its
component, and no component is ever gathered in one task. Tables between the steps stand in the shared
folder. Nodes are of any one type that has an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import Scratch


def _roots(scratch: Scratch, up: DataFrame, most_rounds: int) -> DataFrame:
    """(a, b): from each node and its parent to each node and the root of its tree."""
    for _ in range(most_rounds):
        far = up.select(F.col("a").alias("b"), F.col("b").alias("_far"))
        new = scratch.keep(up.join(far, "b", "left").select("a", F.coalesce("_far", "b").alias("b"), F.col("_far").isNotNull().alias("moved")), "up")
        scratch.drop(up)
        up = new.select("a", "b")
        up._sk_path = new._sk_path
        if new.where("moved").isEmpty():
            return up
    raise RuntimeError(f"trees are deeper than 2**{most_rounds}")


def connected_components(spark: SparkSession, edges: DataFrame, u: str = "u", v: str = "v", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of an edge; a component's name is its smallest node.

    Edges with a null end and loops link nothing; a node that only has loops is its own component.
    An empty edge table gives no rows.
    """
    scratch = Scratch(spark, "components")
    given = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null")
    first = scratch.keep(given.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "edges")
    nodes = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now, name = first.where("a <> b"), None
    for _ in range(most_rounds):
        if now.isEmpty():
            break
        root = _roots(scratch, scratch.keep(now.groupBy("a").agg(F.min("b").alias("b")), "up"), most_rounds)
        # the larger end of every edge has hooked; the smaller one may be a root
        left = now.join(root.withColumnRenamed("b", "ra"), "a").select("ra", "b")
        both = left.join(root.select(F.col("a").alias("b"), F.col("b").alias("rb")), "b", "left").select("ra", F.coalesce("rb", "b").alias("rb")).where("ra <> rb")
        now = scratch.keep(both.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "edges")
        step = root.select(F.col("a").alias("component"), F.col("b").alias("_to"))
        before = nodes.select("node", F.col("node").alias("component")) if name is None else name
        name = scratch.keep(before.join(step, "component", "left").select("node", F.coalesce("_to", "component").alias("component")), "names")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.select("node", F.col("node").alias("component")) if name is None else name
