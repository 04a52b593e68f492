"""A graph as three DataFrames, its JSON form, and generated graphs."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.schema import DIAGNOSTICS, EDGES, NODES


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    diagnostics: DataFrame
    meta: dict[str, Any] = field(default_factory=dict)


def conform(df: DataFrame, schema) -> DataFrame:  # noqa: ANN001
    """df with exactly the schema's columns; those it lacks are null."""
    return df.select(*[(F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def read_json(spark: SparkSession, path: str) -> Graph:
    """A graph document: one JSON object with meta, nodes, edges and diagnostics."""
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    rows = lambda name: doc.select(F.explode(F.variant_get("v", f"$.{name}", "array<variant>")).alias("x"))

    def column(name: str, kind: str) -> Column:
        return F.to_json(F.variant_get("x", f"$.{name}", "variant")) if name in ("extensions", "detail", "details") else F.try_variant_get("x", f"$.{name}", kind)

    def table(name: str, schema) -> DataFrame:  # noqa: ANN001
        cols = [column("extensions.language" if f.name == "language" else f.name, f.dataType.simpleString()).alias(f.name) for f in schema.fields]
        return rows(name).select(*cols)

    meta = json.loads(doc.select(F.to_json(F.variant_get("v", "$.meta", "variant"))).first()[0] or "{}")
    return Graph(table("nodes", NODES), table("edges", EDGES), table("diagnostics", DIAGNOSTICS), meta)


def canonical_digest(document: Any) -> str:
    """SHA-256 of compact JSON with sorted keys; NaN is refused."""
    return hashlib.sha256(json.dumps(document, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def _plain(row: Any) -> dict[str, Any]:
    out = row.asDict(recursive=True)
    out.pop("language", None)
    for name in ("extensions", "detail", "details"):
        if isinstance(out.get(name), str):
            out[name] = json.loads(out[name])
    optional = ("extensions", "signature", "display_name", "return_behavior", "execution_kind", "return_sites", "details", "node_id", "edge_id")
    return {k: v for k, v in out.items() if v is not None or k not in optional}


def write_json(graph: Graph, path: str, meta: dict[str, Any]) -> str:
    """Writes a graph as one document by an atomic replacement, in its fixed order; returns its digest.

    One document is one file by its format, so the rows pass through the driver, one partition at a time, and
    are neither held nor written twice; use bundles for graphs of any size.
    """
    order = {"nodes": ["id"], "edges": ["id"], "diagnostics": [F.coalesce("file", F.lit("")), F.coalesce("span.start_line", F.lit(0)), "code", "message"]}
    plain: dict[str, Any] = {"schema_version": "1.0", "meta": meta}
    digest = hashlib.sha256()
    staged = f"{path}.{os.getpid()}.tmp"
    with open(staged, "w", encoding="utf-8") as f:

        def put(text: str) -> None:
            f.write(text)
            digest.update(text.encode())

        text = lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
        for k, name in enumerate(sorted([*plain, *order])):
            put(("," if k else "{") + text(name) + ":")
            if name in plain:
                put(text(plain[name]))
                continue
            put("[")
            for i, r in enumerate(getattr(graph, name).orderBy(*order[name]).toLocalIterator()):
                put(("," if i else "") + text(_plain(r)))
            put("]")
        put("}")
    os.replace(staged, path)
    return digest.hexdigest()


def synthetic(spark: SparkSession, nodes: int, edges_per_node: int = 3, seed: int = 20260816) -> Graph:
    """A generated graph: a module for every 25 nodes, functions dealt to them in turn, edges by hashes."""
    modules = max(1, nodes // 25)
    ids = spark.range(nodes).withColumn("module", F.col("id") % modules)
    is_module = F.col("id") < modules
    name = F.when(is_module, F.concat(F.lit("m"), "id")).otherwise(F.concat(F.lit("m"), "module", F.lit(".f"), "id"))
    made = ids.select(
        F.concat(F.lit("n"), "id").alias("id"), F.when(is_module, "module").otherwise("function").alias("kind"), name.alias("qualified_name"), name.alias("display_name"),
        F.concat(F.lit("src/m"), "module", F.lit(".py")).alias("file"), F.when(~is_module, F.concat(F.lit("n"), "module")).alias("parent_id"), F.lit("public").alias("visibility"), F.lit("python").alias("language"),
    )
    kinds = F.array(*map(F.lit, ("calls", "imports", "references", "inherits", "dynamic_imports")))
    draws = spark.range(nodes).select("id", F.explode(F.sequence(F.lit(1), F.lit(edges_per_node))).alias("k"))
    h = F.xxhash64(F.lit(seed), "id", "k")
    links = draws.select(F.concat(F.lit("n"), "id").alias("source_id"), F.concat(F.lit("n"), F.pmod(h, F.lit(nodes))).alias("target_id"), F.element_at(kinds, F.pmod(F.shiftright(h, 32), F.lit(5)).cast("int") + 1).alias("relation_type"), "k")
    links = links.dropDuplicates(["source_id", "target_id", "relation_type"])
    open_ = (F.col("relation_type") == "dynamic_imports") & (F.pmod(F.xxhash64("source_id", "k"), F.lit(7)) == 0)
    edges = links.select(
        "source_id", "target_id", "relation_type", F.when(open_, "unresolved").otherwise("resolved").alias("resolution_status"), F.when(open_, 0.2).otherwise(1.0).alias("confidence")
    ).unionByName(made.where("parent_id is not null").select(F.col("parent_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("contains").alias("relation_type"), F.lit("resolved").alias("resolution_status"), F.lit(1.0).alias("confidence")))
    edges = edges.withColumns({"id": F.concat(F.lit("edge:"), F.substring(F.sha1(F.concat_ws("\x1f", "source_id", "target_id", "relation_type")), 1, 20)), "provenance": F.lit("ast"), "detail": F.lit("{}")})
    return Graph(conform(made, NODES), conform(edges, EDGES), spark.createDataFrame([], DIAGNOSTICS))
