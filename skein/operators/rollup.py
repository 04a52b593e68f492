"""Roll-ups of a graph to its modules, and the chunk sets that tell which parts a view has to load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.shared import written


def ancestors(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, depth): every node with itself (0) and all that contain it, however deep. A cycle ends where it closes."""
    nodes = written(nodes.select("id", "parent_id"))
    up = nodes.select(F.col("id").alias("_id"), F.col("parent_id").alias("_parent"))
    level = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"), F.array("id").alias("_path"))
    out = level
    while True:
        nxt = level.join(up, F.col("ancestor") == F.col("_id")).where("_parent is not null and not array_contains(_path, _parent)")
        level = written(nxt.select("id", F.col("_parent").alias("ancestor"), (F.col("depth") + 1).alias("depth"), F.array_append("_path", F.col("_parent")).alias("_path")))
        if level.isEmpty():
            return out.drop("_path")
        out = out.union(level)


def nearest_marked(starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, found): the nearest marked node above each start. starts: (id); nodes: (id, parent_id, marked).

    Unmarked nodes point at their parents, marked ones at themselves, and pointers double: a logarithmic
    number of joins, and no paths. What is on a cycle without a mark, or ends at a root without one, has none.
    """
    stop = F.col("marked") | F.col("parent_id").isNull()
    now = written(nodes.select("id", F.when(stop, F.col("id")).otherwise(F.col("parent_id")).alias("up"), F.lit(False).alias("moved")).dropDuplicates(["id"]))
    total, reach = now.count(), 1
    while reach <= total:
        far = now.select(F.col("id").alias("up"), F.col("up").alias("_next"))
        now = written(now.select("id", "up").join(far, "up", "left").select("id", F.coalesce("_next", "up").alias("up"), (F.col("_next") != F.col("up")).alias("moved")))
        reach *= 2
        if now.where("moved").isEmpty():
            break
    hit = nodes.where("marked").select(F.col("id").alias("up"))
    return starts.select("id").join(now.select("id", "up"), "id").join(hit, "up", "left_semi").select("id", F.col("up").alias("found"))


def virtual_module(kind: Column, language: Column) -> Column:
    """The stand-in module of a node that no module contains, by kind and language."""
    bucket = F.when(kind == "external", "external").otherwise("unresolved")
    return F.concat(F.lit("bundle:virtual-module:"), F.substring(F.sha1(F.concat_ws("\x1f", bucket, F.coalesce(language, F.lit("unknown")))), 1, 16))


def node_modules(nodes: DataFrame) -> DataFrame:
    """(id, module_id, found_by): the module of the node's file, else the nearest module that contains it, else a virtual one."""
    of_file = nodes.where("kind = 'module' and file <> ''").groupBy("file").agg(F.max("id").alias("_by_file"))
    placed = nodes.join(of_file, "file", "left").select("id", "kind", "language", "parent_id", "_by_file")
    rest = placed.where("_by_file is null")
    marked = nodes.select("id", "parent_id", (F.col("kind") == "module").alias("marked"))
    nearest = nearest_marked(rest.where("parent_id is not null or kind = 'module'"), marked).withColumnRenamed("found", "_by_parent")
    out = placed.join(nearest, "id", "left")
    module = F.coalesce("_by_file", "_by_parent", virtual_module(F.col("kind"), F.col("language")))
    how = F.when(F.col("_by_file").isNotNull(), "file").when(F.col("_by_parent").isNotNull(), "parent").otherwise("virtual")
    return out.select("id", module.alias("module_id"), how.alias("found_by"))


def with_modules(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """edges with the modules of both ends."""
    ends = lambda end: modules.select(F.col("id").alias(f"{end}_id"), F.col("module_id").alias(f"{end}_module"))
    return edges.join(ends("source"), "source_id").join(ends("target"), "target_id")


GROUP = ("source_module", "target_module", "relation_type", "resolution_status")


def edge_groups(edges: DataFrame) -> DataFrame:
    """Edges between different modules in groups, with counts, the range of confidence and the first edge.

    edges has both modules; a document holds its edges by id, so the first is the one with the least.
    """
    across = edges.where("source_module <> target_module")
    grouped = across.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("count"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"), F.min("id").alias("representative_edge_id"))
    return grouped.withColumn("group_id", F.substring(F.sha1(F.concat_ws("\x1f", *GROUP)), 1, 20))


def pseudo_edges(groups: DataFrame) -> DataFrame:
    """Groups as edges for display; a group has no confidence of its own."""
    return groups.select(F.concat(F.lit("overview:"), "group_id").alias("id"), F.col("source_module").alias("source_id"), F.col("target_module").alias("target_id"), "relation_type", "resolution_status", F.lit(None).cast("double").alias("confidence"), "count")


def with_ordinals(df: DataFrame, by: str = "id") -> DataFrame:
    """df with `ordinal`, its place from 0 in the order of `by`.

    A global row number would sort everything in one task. Rows are dealt by range, numbered within
    their range, and the ranges' sizes are summed up: two passes, both parallel. What was dealt is written
    in between: bounds come from a sample, so dealing again could cut the ranges elsewhere.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, by).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = dealt.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(by)))
    return numbered.join(F.broadcast(before), "_part").withColumn("ordinal", F.col("_before") + F.col("_row") - 1).drop("_part", "_row", "_before")  # one row per partition


def sibling_index(rows: DataFrame, parent: str, order: str) -> DataFrame:
    """rows with `sibling`, a row's place from 0 among those of its parent."""
    return rows.withColumn("sibling", F.row_number().over(Window.partitionBy(parent).orderBy(order)) - 1)


def chunked(df: DataFrame, size: int, by: str = "id") -> DataFrame:
    """df with `chunk`: consecutive runs of `size` rows in the order of `by`."""
    if size < 1:
        raise ValueError("chunk size must be positive")
    return with_ordinals(df, by).withColumn("chunk", F.floor(F.col("ordinal") / size).cast("int"))


def chunk_ranges(chunks: DataFrame) -> DataFrame:
    """(chunk, count, first, last): running row numbers of chunks. chunks: (chunk, count), one row per chunk."""
    w = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("count").over(w)
    return chunks.select("chunk", "count", (upto - F.col("count")).alias("first"), (upto - 1).alias("last"))


def chunk_sets(keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """For every key of keys the sorted chunks that rows of (key, chunk) put it in; empty if none."""
    found = rows.groupBy(key).agg(F.array_sort(F.collect_set("chunk")).alias("chunks"))
    return keys.select(key).distinct().join(found, key, "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<int>")))


def display_groups(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """Edges drawn between the ancestors that a zoom level shows: shown has (id, display_id); loops go, counts add up."""
    ends = lambda end: shown.select(F.col("id").alias(f"{end}_id"), F.col("display_id").alias(f"{end}_module"))
    drawn = edges.join(ends("source"), "source_id").join(ends("target"), "target_id").where("source_module <> target_module")
    return drawn.groupBy(*GROUP).agg(F.sum(F.coalesce("count", F.lit(1))).alias("count"))


LOW, HIGH = 0.55, 1.25


def displayed(nodes: DataFrame, modules: DataFrame, zoom: float) -> DataFrame:
    """(id, display_id): modules when zoomed out, all nodes when zoomed in.

    Between, functions, methods and lambdas show as the class that holds them, or else as their module.
    """
    if zoom >= HIGH:
        return nodes.select("id", F.col("id").alias("display_id"))
    if zoom < LOW:
        return modules.select("id", F.col("module_id").alias("display_id"))
    holder = nodes.where("kind = 'class'").select(F.col("id").alias("parent_id"), F.lit(True).alias("_class"))
    placed = nodes.select("id", "kind", "parent_id").join(holder, "parent_id", "left").join(modules.select("id", "module_id"), "id", "left")
    inner = F.when(F.col("_class"), F.col("parent_id")).otherwise(F.col("module_id"))
    return placed.select("id", F.when(F.col("kind").isin("function", "method", "lambda"), inner).otherwise(F.col("id")).alias("display_id"))


def bounding_boxes(positions: DataFrame, modules: DataFrame) -> DataFrame:
    """Box of a module around its members: positions has (id, x, y)."""
    box = [f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y")]
    return positions.join(modules, "id").groupBy("module_id").agg(*box)
