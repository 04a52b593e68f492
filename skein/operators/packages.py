"""Aggregates over files and graphs: packages, metadata, completeness and equality of sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.merge import difference


def go_packages(files: DataFrame) -> DataFrame:
    """(folder, package, base, import_path, n_files): packages that share a base path take their name behind a # but for one.

    files: (path, folder, package, base). The one that keeps the base is the first by name that is no test package, or the first.
    """
    packages = files.groupBy("folder", "package", "base").agg(F.count(F.lit(1)).alias("n_files"))
    order = Window.partitionBy("base").orderBy(F.endswith("package", F.lit("_test")), "package", "folder")
    first = F.row_number().over(order) == 1
    return packages.withColumn("import_path", F.when(first, F.col("base")).otherwise(F.concat("base", F.lit("#"), "package")))


def with_default_language(nodes: DataFrame, component: str) -> DataFrame:
    """Nodes of a component without a language get it, if the component is Python's, whose nodes carry none."""
    return nodes.withColumn("language", F.coalesce("language", F.lit("python"))) if component == "python" else nodes


def merged_texts(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value): the distinct values that aren't empty, in order, joined by semicolons."""
    some = F.array_sort(F.collect_set(F.nullif(F.col(value), F.lit(""))))
    return rows.groupBy(by).agg(F.array_join(some, ";").alias(value))


def definition_counts(nodes: DataFrame) -> DataFrame:
    return nodes.where("file is not null").groupBy("file", "kind", "qualified_name").agg(F.count(F.lit(1)).alias("n"))


def relation_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Resolved edges between nodes that files define, counted by relation and the names of their ends."""
    end = lambda e: nodes.where("file is not null").select(F.col("id").alias(f"{e}_id"), F.col("qualified_name").alias(e))
    both = edges.where("resolution_status = 'resolved'").join(end("source"), "source_id").join(end("target"), "target_id")
    return both.groupBy("relation_type", "source", "target").agg(F.count(F.lit(1)).alias("n"))


def coverage(expected: DataFrame, nodes: DataFrame) -> DataFrame:
    """Definitions (file, kind, line, col) that nodes lack or have too many of, with side and n."""
    actual = nodes.where("span is not null").select("file", "kind", F.col("span.start_line").alias("line"), F.col("span.start_col").alias("col"))
    return difference(expected.select("file", "kind", "line", "col"), actual)


def same_sets(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, however often."""
    return difference(a.distinct(), b.select(a.columns).distinct()).isEmpty()
