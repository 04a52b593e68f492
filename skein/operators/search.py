"""Search of node names by substring, the character index, and ranked listings."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ("id", "qualified_name", "display_name", "file")
LIMIT = 80


def normal(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower()


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).lower())


def normalised(text: Column) -> Column:
    """NFKC, then lower case. ASCII text needs no normal form and stays in the JVM."""
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), F.lower(text)).otherwise(_nfkc(text))


def haystack(separator: str = "\n") -> Column:
    return F.concat_ws(separator, *[F.coalesce(F.col(c), F.lit("")) for c in FIELDS])


def search(nodes: DataFrame, query: str, limit: int = LIMIT, languages: list[str] | None = None, separator: str = "\n") -> DataFrame:
    """Nodes whose id, names or file hold the query, by id; none for a blank query."""
    if languages is not None:
        nodes = nodes.where(F.col("language").isNull() | F.col("language").isin(languages))
    return holding(nodes, haystack(separator), query, "id", limit)


def holding(rows: DataFrame, text: Column, query: str, order: str, limit: int = LIMIT) -> DataFrame:
    """Rows whose text holds the query, both in normal form, the first `limit` in an order."""
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
        raise ValueError("limit must be a positive integer")
    wanted = normal(query).strip()
    if not wanted:
        return rows.limit(0)
    return rows.where(F.contains(normalised(text), F.lit(wanted))).orderBy(order).limit(limit)


def search_page(nodes: DataFrame, query: str, limit: int = LIMIT, languages: list[str] | None = None) -> DataFrame:
    """As search(), with `truncated`, whether there are more."""
    from pyspark.sql import Window

    found = search(nodes, query, limit + 1, languages, " ")
    ranked = found.withColumns({"_n": F.count(F.lit(1)).over(Window.partitionBy()), "_k": F.row_number().over(Window.orderBy("id"))})  # limit + 1 rows
    return ranked.where(F.col("_k") <= limit).withColumn("truncated", F.col("_n") > limit).drop("_n", "_k")


def search_key(character: Column) -> Column:
    """Name of a character's list: u and its code point in hex."""
    return F.concat(F.lit("u"), F.lower(F.hex(F.ascii(character))))


def postings(records: DataFrame) -> DataFrame:
    """(key, character, n): how many records hold each character other than space. records has (ordinal, text)."""
    chars = records.select("ordinal", F.explode(F.array_distinct(F.split("text", ""))).alias("character")).where("trim(character) <> ''")
    return chars.groupBy("character").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last")).withColumn("key", search_key(F.col("character")))


def top_diagnostics(diagnostics: DataFrame, limit: int = 200) -> DataFrame:
    """Errors first, then warnings, then notes, then anything else."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).when(F.col("severity") == "info", 2).otherwise(3)
    return diagnostics.withColumn("rank", rank).orderBy("rank", "file", "code", "message").limit(limit)


def drawn_edges(edges: DataFrame, selected: Column, focused: Column, limit: int = 24_000) -> DataFrame:
    """The edges to draw, those of the selection first, then of the focused module; `omitted` tells how many are left out."""
    ranked = edges.withColumn("priority", F.when(selected, 0).when(focused, 1).otherwise(2))
    total = edges.agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("omitted"))
    return ranked.orderBy("priority", "id").limit(limit).crossJoin(total)  # a table of one row


def contents(nodes: DataFrame, limit: int = 300) -> DataFrame:
    return nodes.orderBy("qualified_name", "id").limit(limit)


def neighbourhood(nodes: DataFrame, edges: DataFrame, node_id: str) -> tuple[DataFrame, DataFrame]:
    """Edges at a node, and the nodes at their ends."""
    near = edges.where((F.col("source_id") == node_id) | (F.col("target_id") == node_id))
    ends = near.select(F.explode(F.array("source_id", "target_id")).alias("id")).union(near.sparkSession.createDataFrame([(node_id,)], "id string"))
    return nodes.join(ends.distinct(), "id", "left_semi"), near


def visible(nodes: DataFrame, edges: DataFrame, languages: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of the languages or of none, and edges with both ends among them."""
    kept = nodes.where(F.col("language").isNull() | F.col("language").isin(languages))
    ids = kept.select("id")
    seen = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return kept, seen
