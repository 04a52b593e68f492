"""A graph as a folder of tables in chunks, with an index of counts and digests, for readers that load parts.

Tables: nodes, edges and diagnostics in chunks of their fixed order; groups, the edges between modules, with
modules as ordinals of the nodes; records, what a search looks at; postings, for each character the ordinals
of the records that hold it, in chunks; modules, which chunks a module's members, edges and groups are in.
A table is Parquet, partitioned by chunk, so a reader of some chunks touches only their folders. A chunk's
digest is made of its rows' digests, in any order. The index is written last: a folder without one is no bundle.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators import merge, rollup, search, validate
from skein.sources.graph import Graph
from skein.sources.publish import Journal, recover
from skein.sources.shared import written

#: Rows of a chunk.
SIZES = {"nodes": 2000, "edges": 5000, "diagnostics": 2000, "groups": 2000, "records": 2000, "postings": 5000, "modules": 2000}
FORMAT = "skein-bundle-1"


class BundleError(ValueError):
    pass


@dataclass
class Bundle:
    spark: SparkSession
    folder: str
    index: dict[str, Any]

    def table(self, name: str, chunks: list[int] | None = None) -> DataFrame:
        """A table of the bundle, or some of its chunks."""
        schema = T.StructType.fromJson(self.index["schemas"][name])
        if not self.index["chunks"][name]:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        return rows if chunks is None else rows.where(F.col("chunk").isin(chunks))

    def graph(self) -> Graph:
        return Graph(*(self.table(n).drop("chunk", "ordinal") for n in ("nodes", "edges", "diagnostics")), self.index["meta"])


def records(nodes: DataFrame, modules: DataFrame) -> DataFrame:
    """What a search looks at of each node. nodes has ordinal; modules: (id, module_id)."""
    return nodes.join(modules.select("id", F.col("module_id").alias("module")), "id", "left").select("ordinal", "id", "kind", "qualified_name", "display_name", "file", "language", "module")


def compact_groups(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Groups with their modules as ordinals of nodes; -1 for a virtual module, which is named besides."""
    place = lambda end: nodes.select(F.col("id").alias(f"{end}_module"), F.col("ordinal").alias(f"{end}_ordinal"))
    out = groups.join(place("source"), "source_module", "left").join(place("target"), "target_module", "left")
    virtual = lambda end: F.when(F.col(f"{end}_ordinal").isNull(), F.col(f"{end}_module")).alias(f"{end}_virtual")
    return out.select("group_id", *[F.coalesce(f"{e}_ordinal", F.lit(-1)).alias(f"{e}_ordinal") for e in ("source", "target")], virtual("source"), virtual("target"), "relation_type", "resolution_status", "count", "min_confidence", "max_confidence", "representative_edge_id")


def posting_rows(found: DataFrame) -> DataFrame:
    """(key, ordinal) for each character other than space in a record's normalised text."""
    text = search.normalised(search.haystack())
    chars = found.select("ordinal", F.explode(F.array_distinct(F.split(text, ""))).alias("character")).where(~F.col("character").rlike(r"^\s*$"))
    return chars.select(search.search_key(F.col("character")).alias("key"), "ordinal")


def _postings(found: DataFrame, size: int) -> DataFrame:
    """(key, part, ordinals): lists of `size` neighbouring ordinals at most, so no list of a common character is ever gathered whole."""
    return posting_rows(found).withColumn("part", F.floor(F.col("ordinal") / size)).groupBy("key", "part").agg(F.array_sort(F.collect_list("ordinal")).alias("ordinals"))


def tables(graph: Graph, sizes: dict[str, int]) -> dict[str, DataFrame]:
    nodes = written(rollup.chunked(graph.nodes, sizes["nodes"]))
    edges = written(rollup.chunked(graph.edges, sizes["edges"]))
    order = F.struct(F.coalesce("file", F.lit("")), F.coalesce("span.start_line", F.lit(0)), "code", "message", F.coalesce("node_id", F.lit("")), F.coalesce("edge_id", F.lit("")))
    diagnostics = rollup.chunked(graph.diagnostics.withColumn("_order", order), sizes["diagnostics"], "_order").drop("_order")
    modules = written(rollup.node_modules(nodes))
    joined = written(rollup.with_modules(edges, modules))
    groups = written(rollup.chunked(rollup.edge_groups(joined), sizes["groups"], "group_id"))
    found = written(records(nodes, modules))
    ends = lambda df, chunk: df.select(F.explode(F.array_distinct(F.array("source_module", "target_module"))).alias("module_id"), F.col(chunk).alias("chunk"))
    sets = modules.select("module_id").distinct()
    for name, rows in (("node_chunks", modules.select("id", "module_id").join(nodes.select("id", "chunk"), "id")), ("edge_chunks", ends(joined, "chunk")), ("group_chunks", ends(groups, "chunk"))):
        sets = sets.join(rollup.chunk_sets(sets, rows, "module_id").withColumnRenamed("chunks", name), "module_id")
    placed = edges.select(F.col("id").alias("representative_edge_id"), F.col("chunk").alias("representative_edge_chunk"))
    compact = compact_groups(groups, nodes).join(groups.select("group_id", "ordinal", "chunk"), "group_id").join(placed, "representative_edge_id", "left")
    return {
        "nodes": nodes, "edges": edges, "diagnostics": diagnostics, "groups": compact,
        "records": found.withColumn("chunk", F.floor(F.col("ordinal") / sizes["records"]).cast("int")),
        "postings": _postings(found, sizes["postings"]).withColumn("chunk", F.col("part").cast("int")).drop("part"),
        "modules": rollup.chunked(sets, sizes["modules"], "module_id").drop("ordinal"),
    }


def _row(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns) if c != "chunk"]))


def digests(df: DataFrame) -> DataFrame:
    """(chunk, count, sha256): the digest of the sums of four parts of the rows' digests, which no order and no gathering of rows enters."""
    rows = df.select("chunk", F.sha2(_row(df), 256).alias("d"))
    part = lambda k: F.sum(F.conv(F.substring("d", 16 * k + 1, 16), 16, 10).cast("decimal(38,0)"))
    sums = rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("count"), *[part(k).alias(f"p{k}") for k in range(4)])
    return sums.select("chunk", "count", F.sha2(F.concat_ws("-", "count", *[f"p{k}" for k in range(4)]), 256).alias("sha256"))


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    there, fs = _fs(spark, path)
    out = fs.create(there, False)
    out.write(bytearray(text.encode()))
    out.close()


def write(graph: Graph, folder: str, sizes: dict[str, int] | None = None, force: bool = False, full: bool = True) -> Bundle:
    """Splits a graph into a bundle: staged beside the folder, checked (in full, or quickly), and put in its place by a journal."""
    spark, folder = graph.nodes.sparkSession, folder.rstrip("/")
    sizes = SIZES | (sizes or {})
    if min(sizes.values()) < 1:
        raise BundleError("chunk sizes must be positive")
    recover(spark, folder)
    there, fs = _fs(spark, folder)
    if fs.exists(there) and len(fs.listStatus(there)) > 0 and not force:
        raise BundleError(f"{folder} is not empty")
    journal = Journal(spark, folder)
    told = journal.begin()
    try:
        _stage(graph, told["staged"], sizes)
        quick_check(spark, told["staged"])
        wrong = violations(spark, told["staged"]).first() if full else None
        if wrong is not None:
            raise BundleError(f"the staged bundle is wrong: {wrong.rule}: {wrong['item']}")
    except Exception:
        journal.give_up(told)
        raise
    journal.finish(told)
    return read(spark, folder)


def _stage(graph: Graph, staged: str, sizes: dict[str, int]) -> None:
    spark = graph.nodes.sparkSession
    index: dict[str, Any] = {"format": FORMAT, "meta": graph.meta, "sizes": sizes, "counts": {}, "chunks": {}, "schemas": {}}
    for name, rows in tables(graph, sizes).items():
        rows.repartition("chunk").sortWithinPartitions("chunk").write.partitionBy("chunk").parquet(f"{staged}/{name}")
        back = spark.read.schema(rows.schema).parquet(f"{staged}/{name}")
        told = [r.asDict() for r in digests(back).orderBy("chunk").collect()]  # one row per chunk
        index["schemas"][name] = json.loads(rows.schema.json())
        index["chunks"][name] = told
        index["counts"][name] = sum(r["count"] for r in told)
    _write_text(spark, f"{staged}/index.json", json.dumps(index, sort_keys=True))


def read(spark: SparkSession, folder: str) -> Bundle:
    """A bundle by its index."""
    folder = folder.rstrip("/")
    there, fs = _fs(spark, f"{folder}/index.json")
    if not fs.exists(there):
        raise BundleError(f"{folder} has no index")
    try:
        index = json.loads(spark.read.text(f"{folder}/index.json", wholetext=True).first()[0])
    except (json.JSONDecodeError, TypeError) as e:
        raise BundleError(f"the index of {folder} is no JSON") from e
    if not isinstance(index, dict) or index.get("format") != FORMAT or not isinstance(index.get("chunks"), dict):
        raise BundleError(f"the index of {folder} is of another format")
    return Bundle(spark, folder, index)


def quick_check(spark: SparkSession, folder: str) -> Bundle:
    """The index, and whether the folders of all chunks are there; reads no rows."""
    bundle = read(spark, folder)
    for name, chunks in bundle.index["chunks"].items():
        for c in chunks:
            there, fs = _fs(spark, f"{bundle.folder}/{name}/chunk={int(c['chunk'])}")
            if not fs.exists(there):
                raise BundleError(f"chunk {c['chunk']} of {name} is missing")
    return bundle


def violations(spark: SparkSession, folder: str) -> DataFrame:
    """(rule, item) of all that is wrong with a bundle: digests, the graph's contract, and tables that differ from what the graph gives."""
    bundle = quick_check(spark, folder)
    parts = [spark.createDataFrame([], "rule string, item string")]
    for name, chunks in bundle.index["chunks"].items():
        told = spark.createDataFrame([(c["chunk"], c["count"], c["sha256"]) for c in chunks], "chunk int, count long, sha256 string")
        there = digests(bundle.table(name)).select("chunk", "count", "sha256")
        parts.append(merge.difference(told, there).select(F.lit(f"chunks of {name} differ from the index").alias("rule"), F.col("chunk").cast("string").alias("item")).distinct())
    graph = bundle.graph()
    parts.append(validate.violations(graph))
    made = tables(graph, bundle.index["sizes"])
    as_json = lambda df: df.select(_row(df).alias("row"))
    for name in ("groups", "records", "postings", "modules"):
        differ = merge.difference(as_json(made[name]), as_json(bundle.table(name)))
        parts.append(differ.select(F.concat(F.lit(f"{name}: "), "side").alias("rule"), F.substring("row", 1, 200).alias("item")))
    return reduce(DataFrame.union, parts)


def candidates(found: DataFrame, postings: DataFrame, query: str, limit: int = search.LIMIT) -> DataFrame:
    """Records that hold the query: those that its first character's list names, looked at in their order until `limit` are found, by id."""
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
        raise BundleError("limit must be a positive integer")
    wanted = search.normal(query.strip())
    if not wanted:
        return found.limit(0)
    listed = postings.where(F.col("key") == f"u{ord(wanted[0]):x}").select(F.explode("ordinals").alias("ordinal"))
    hit = found.join(listed, "ordinal", "left_semi").where(F.contains(search.normalised(search.haystack()), F.lit(wanted)))
    return hit.orderBy("ordinal").limit(limit).orderBy("id")


def search_bundle(bundle: Bundle, query: str, limit: int = search.LIMIT) -> DataFrame:
    return candidates(bundle.table("records"), bundle.table("postings"), query, limit)


def module_detail(bundle: Bundle, module_id: str) -> tuple[DataFrame, DataFrame]:
    """A module's nodes, and the edges at them, from the chunks that hold any of them."""
    row = bundle.table("modules").where(F.col("module_id") == module_id).first()
    if row is None:
        raise BundleError(f"no such module: {module_id}")
    own = bundle.table("records").where(F.col("module") == module_id).select("id")
    nodes = bundle.table("nodes", row.node_chunks).join(own, "id", "left_semi")
    edges = bundle.table("edges", row.edge_chunks)
    ends = lambda e: own.select(F.col("id").alias(e))
    at = edges.join(ends("source_id"), "source_id", "left_semi").select(edges.columns).union(edges.join(ends("target_id"), "target_id", "left_semi").select(edges.columns))
    return nodes, at.dropDuplicates(["id"])


def representative(bundle: Bundle, group_id: str) -> DataFrame:
    """The edge that stands for a group, from the one chunk that holds it."""
    group = bundle.table("groups").where(F.col("group_id") == group_id).select("representative_edge_id", "representative_edge_chunk").first()
    if group is None:
        raise BundleError(f"no such group: {group_id}")
    return bundle.table("edges", [group.representative_edge_chunk]).where(F.col("id") == group.representative_edge_id)


def neighbourhood_page(bundle: Bundle, module_id: str, cursor: int = 0, chunks: int = 4) -> tuple[DataFrame, int | None]:
    """The groups at a module from the next `chunks` chunks of its list after `cursor`, and the cursor of the page after it, null at the end."""
    row = bundle.table("modules").where(F.col("module_id") == module_id).select("group_chunks").first()
    if row is None:
        raise BundleError(f"no such module: {module_id}")
    if chunks < 1 or cursor < 0:
        raise BundleError("a page has one chunk at least and begins at 0 or later")
    page = row.group_chunks[cursor : cursor + chunks]
    own = bundle.table("nodes").where(F.col("id") == module_id).select("ordinal").first()
    ends = [(F.col(f"{e}_ordinal") == own.ordinal) if own is not None else (F.col(f"{e}_virtual") == module_id) for e in ("source", "target")]
    after = cursor + chunks
    return bundle.table("groups", page).where(ends[0] | ends[1]), after if after < len(row.group_chunks) else None
