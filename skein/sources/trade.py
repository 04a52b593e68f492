"""The driver's tables read as a graph: regions are modules, nations classes, customers and suppliers functions, line items edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.graph import Graph, conform
from skein.sources.schema import DIAGNOSTICS, EDGES, NODES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, id_: str, key: str, name: str, kind, parent, file, visibility, language) -> DataFrame:  # noqa: ANN001, PLR0913
        return df.select(F.concat(F.lit(id_), F.col(key)).alias("id"), kind.alias("kind"), F.col(name).alias("qualified_name"), F.lower(name).alias("display_name"), file.alias("file"), parent.alias("parent_id"), visibility.alias("visibility"), language.alias("language"))

    regions = rows(t("region"), "r", "r_regionkey", "r_name", F.lit("module"), none, F.concat(F.lit("src/"), F.lower("r_name")), F.lit("public"), none)
    nations = rows(t("nation"), "n", "n_nationkey", "n_name", F.lit("class"), F.concat(F.lit("r"), "n_regionkey"), none, F.lit("public"), F.lit("sql"))
    customers = rows(t("customer"), "c", "c_custkey", "c_name", F.lit("function"), F.concat(F.lit("n"), "c_nationkey"), none, F.when(F.col("c_acctbal") < 0, "private").otherwise("public"), F.lower("c_mktsegment"))
    loose = F.col("s_acctbal") < 0
    suppliers = rows(t("supplier"), "s", "s_suppkey", "s_name", F.when(loose, "external").otherwise("function"), F.when(~loose, F.concat(F.lit("n"), "s_nationkey")), none, F.lit("unknown"), F.when(loose, "sql").otherwise("python"))
    return conform(regions.unionByName(nations).unionByName(customers).unionByName(suppliers), NODES)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    relation = F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "N", "imports").otherwise("references")
    status = F.when(F.col("l_linestatus") == "O", "resolved").when(F.col("l_quantity") < 10, "unresolved").otherwise("external")
    out = lines.select(
        F.concat_ws(":", F.lit("edge"), "l_orderkey", "l_linenumber").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("source_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_id"),
        relation.alias("relation_type"), status.alias("resolution_status"), F.lit("ast").alias("provenance"), F.col("l_discount").alias("confidence"), F.lit("{}").alias("detail"),
    )
    return conform(out, EDGES)


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    out = table(spark, sf_dir, "events").select(
        F.when(kind == "error", "parse_error").when(kind == "click", "unresolved_call").otherwise("excluded_file").alias("code"),
        F.when(kind == "error", "error").when(kind == "click", "warning").otherwise("info").alias("severity"),
        F.concat(F.lit("event "), "event_id").alias("message"), F.concat(F.lit("f"), F.col("user_id") % 50).alias("file"),
    )
    return conform(out, DIAGNOSTICS)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir), diagnostics(spark, sf_dir))


#: The same three tables as SQL, for the oracle.
NODES_SQL = """n AS (
  SELECT concat('r', r_regionkey) AS id, 'module' AS kind, r_name AS qualified_name, lower(r_name) AS display_name, concat('src/', lower(r_name)) AS file, CAST(NULL AS VARCHAR) AS parent_id, 'public' AS visibility, CAST(NULL AS VARCHAR) AS language FROM region
  UNION ALL SELECT concat('n', n_nationkey), 'class', n_name, lower(n_name), NULL, concat('r', n_regionkey), 'public', 'sql' FROM nation
  UNION ALL SELECT concat('c', c_custkey), 'function', c_name, lower(c_name), NULL, concat('n', c_nationkey), CASE WHEN c_acctbal < 0 THEN 'private' ELSE 'public' END, lower(c_mktsegment) FROM customer
  UNION ALL SELECT concat('s', s_suppkey), CASE WHEN s_acctbal < 0 THEN 'external' ELSE 'function' END, s_name, lower(s_name), NULL, CASE WHEN s_acctbal < 0 THEN NULL ELSE concat('n', s_nationkey) END, 'unknown', CASE WHEN s_acctbal < 0 THEN 'sql' ELSE 'python' END FROM supplier)"""
EDGES_SQL = """e AS (
  SELECT concat('edge:', l_orderkey, ':', l_linenumber) AS id, concat('c', o_custkey) AS source_id, concat('s', l_suppkey) AS target_id,
    CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'imports' ELSE 'references' END AS relation_type,
    CASE WHEN l_linestatus = 'O' THEN 'resolved' WHEN l_quantity < 10 THEN 'unresolved' ELSE 'external' END AS resolution_status,
    'ast' AS provenance, l_discount AS confidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
DIAGNOSTICS_SQL = """d AS (
  SELECT CASE event_type WHEN 'error' THEN 'parse_error' WHEN 'click' THEN 'unresolved_call' ELSE 'excluded_file' END AS code,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'info' END AS severity,
    concat('event ', event_id) AS message, concat('f', user_id % 50) AS file
  FROM events)"""
MODULES_SQL = """m AS (
  SELECT x.id, coalesce(CASE WHEN x.kind = 'module' THEN x.id END, a.id, b.id,
      concat('bundle:virtual-module:', substr(sha1(concat(CASE WHEN x.kind = 'external' THEN 'external' ELSE 'unresolved' END, chr(31), coalesce(x.language, 'unknown'))), 1, 16))) AS module_id,
    CASE WHEN x.kind = 'module' THEN 'file' WHEN a.id IS NOT NULL OR b.id IS NOT NULL THEN 'parent' ELSE 'virtual' END AS found_by
  FROM n x LEFT JOIN n p ON x.parent_id = p.id LEFT JOIN n a ON p.id = a.id AND a.kind = 'module' LEFT JOIN n b ON p.parent_id = b.id AND b.kind = 'module')"""
