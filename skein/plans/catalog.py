"""Registered queries of the graph engine: a DataFrame form and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import display, scalars, web
from skein.functions.extract import records
from skein.operators import infer, merge, packages, report, resolve, rollup, search, validate
from skein.operators import web as web_joins
from skein.plans import analyze, rules, typed
from skein.sources import bundle, trade
from skein.sources.shared import written
from skein.sources.trade import DIAGNOSTICS_SQL, EDGES_SQL, MODULES_SQL, NODES_SQL, table

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}
_N, _E, _D, _M = NODES_SQL, EDGES_SQL, DIAGNOSTICS_SQL, MODULES_SQL


def _query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _FOUND[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _FOUND.items() if s}


def _modules(s: SparkSession, d: str) -> DataFrame:
    return rollup.node_modules(trade.nodes(s, d)).select("id", "module_id")


def _edges_in_modules(s: SparkSession, d: str) -> DataFrame:
    return rollup.with_modules(trade.edges(s, d), _modules(s, d))


# --- roll-ups to modules


@_query(f"""WITH {_N}, {_E}, {_M}
SELECT s.module_id AS source_module, t.module_id AS target_module, relation_type, resolution_status, count(*) AS count, min(confidence) AS min_confidence,
  max(confidence) AS max_confidence, min(e.id) AS representative_edge_id, substr(sha1(concat(s.module_id, chr(31), t.module_id, chr(31), relation_type, chr(31), resolution_status)), 1, 20) AS group_id
FROM e JOIN m s ON e.source_id = s.id JOIN m t ON e.target_id = t.id WHERE s.module_id <> t.module_id GROUP BY ALL""")
def module_edge_groups(s: SparkSession, d: str) -> DataFrame:
    return rollup.edge_groups(_edges_in_modules(s, d))


@_query(f"WITH {_N}, {_M} SELECT id, module_id, found_by FROM m")
def node_to_module(s: SparkSession, d: str) -> DataFrame:
    return rollup.node_modules(trade.nodes(s, d))


@_query(f"""WITH {_N}, {_E}, {_M}, g AS (
  SELECT s.module_id AS sm, t.module_id AS tm, relation_type, resolution_status, count(*) AS count FROM e JOIN m s ON e.source_id = s.id JOIN m t ON e.target_id = t.id WHERE s.module_id <> t.module_id GROUP BY ALL)
SELECT concat('overview:', substr(sha1(concat(sm, chr(31), tm, chr(31), relation_type, chr(31), resolution_status)), 1, 20)) AS id, sm AS source_id, tm AS target_id, relation_type, resolution_status, CAST(NULL AS DOUBLE) AS confidence, count FROM g""")
def overview_pseudo_edges(s: SparkSession, d: str) -> DataFrame:
    return rollup.pseudo_edges(rollup.edge_groups(_edges_in_modules(s, d)))


@_query(f"""WITH {_N}, {_E}, {_M}, v AS (
  SELECT x.id, CASE WHEN x.kind NOT IN ('function', 'method', 'lambda') THEN x.id WHEN p.kind = 'class' THEN x.parent_id ELSE m.module_id END AS display_id
  FROM n x LEFT JOIN n p ON x.parent_id = p.id LEFT JOIN m ON x.id = m.id)
SELECT s.display_id AS source_module, t.display_id AS target_module, relation_type, resolution_status, count(*) AS count
FROM e JOIN v s ON e.source_id = s.id JOIN v t ON e.target_id = t.id WHERE s.display_id <> t.display_id GROUP BY ALL""")
def zoom_edge_groups(s: SparkSession, d: str) -> DataFrame:
    shown = rollup.displayed(trade.nodes(s, d), _modules(s, d), 0.8)
    return rollup.display_groups(trade.edges(s, d).withColumn("count", F.lit(1)), shown)


@_query(f"""WITH {_N}, {_M}, p AS (SELECT concat('c', c_custkey) AS id, CAST(c_nationkey AS DOUBLE) AS x, c_acctbal AS y FROM customer)
SELECT module_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM p JOIN m USING (id) GROUP BY module_id""")
def module_bounding_boxes(s: SparkSession, d: str) -> DataFrame:
    at = table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_nationkey").cast("double").alias("x"), F.col("c_acctbal").alias("y"))
    return rollup.bounding_boxes(at, _modules(s, d))


# --- chunks and ordinals


@_query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 200) AS INTEGER) AS chunk FROM documents")
def chunk_assign(s: SparkSession, d: str) -> DataFrame:
    return rollup.chunked(table(s, d, "documents").select("doc_id"), 200, "doc_id").select("doc_id", "ordinal", "chunk")


@_query("""WITH c AS (SELECT CAST(floor(p_partkey / 300) AS INTEGER) AS chunk, count(*) AS count FROM part GROUP BY 1)
SELECT chunk, count, CAST(sum(count) OVER (ORDER BY chunk) - count AS BIGINT) AS first, CAST(sum(count) OVER (ORDER BY chunk) - 1 AS BIGINT) AS last FROM c""")
def chunk_ranges(s: SparkSession, d: str) -> DataFrame:
    sizes = table(s, d, "part").groupBy(F.floor(F.col("p_partkey") / 300).cast("int").alias("chunk")).agg(F.count(F.lit(1)).alias("count"))
    return rollup.chunk_ranges(sizes)


@_query("""WITH o AS (SELECT o_orderkey, o_custkey, CAST(floor(o_orderkey / 2000) AS INTEGER) AS chunk FROM orders)
SELECT c_custkey AS key, coalesce(list_sort(list_distinct(list(chunk) FILTER (WHERE chunk IS NOT NULL))), []) AS chunks FROM customer LEFT JOIN o ON c_custkey = o_custkey GROUP BY c_custkey""")
def chunk_sets(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders").select(F.col("o_custkey").alias("key"), F.floor(F.col("o_orderkey") / 2000).cast("int").alias("chunk"))
    return rollup.chunk_sets(table(s, d, "customer").select(F.col("c_custkey").alias("key")), rows, "key")


@_query("SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS sibling FROM customer")
def sibling_index(s: SparkSession, d: str) -> DataFrame:
    return rollup.sibling_index(table(s, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey")


@_query("""SELECT p_partkey, concat(p_brand, CASE WHEN k = 0 THEN '' ELSE concat('~', k) END) AS id FROM (
  SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part)""")
def duplicate_id_suffix(s: SparkSession, d: str) -> DataFrame:
    return resolve.distinct_ids(table(s, d, "part").select("p_partkey", "p_brand"), "p_brand", ["p_partkey"]).select("p_partkey", "id")


@_query("SELECT l_orderkey, l_linenumber, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS next_start FROM lineitem")
def next_declaration(s: SparkSession, d: str) -> DataFrame:
    return resolve.next_start(table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@_query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS top FROM events GROUP BY event_type")
def nearest_rank_percentiles(s: SparkSession, d: str) -> DataFrame:
    return report.percentiles(table(s, d, "events"), "event_type", "value")


@_query("SELECT user_id, min(value) AS least, max(value) AS most, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last FROM events GROUP BY user_id")
def resource_summary(s: SparkSession, d: str) -> DataFrame:
    return report.summary(table(s, d, "events"), "user_id", "value", "event_id")


# --- report


@_query(f"""WITH {_N}, {_E}, {_D}
SELECT 'nodes_by_kind' AS facet, kind AS value, count(*) AS n FROM n GROUP BY kind UNION ALL SELECT 'edges_by_relation', relation_type, count(*) FROM e GROUP BY relation_type
UNION ALL SELECT 'edges_by_resolution', resolution_status, count(*) FROM e GROUP BY resolution_status UNION ALL SELECT 'edges_by_provenance', provenance, count(*) FROM e GROUP BY provenance
UNION ALL SELECT 'diagnostics_by_code', code, count(*) FROM d GROUP BY code UNION ALL SELECT 'diagnostics_by_severity', severity, count(*) FROM d GROUP BY severity""")
def report_counts(s: SparkSession, d: str) -> DataFrame:
    return report.counts(trade.graph(s, d))


@_query(f"""WITH {_N}, {_E}, {_D}, x AS (SELECT count(*) AS nodes FROM n), y AS (SELECT count(*) AS edges, sum(CASE WHEN resolution_status IN ('unresolved', 'unsupported') THEN 1 ELSE 0 END) AS bad FROM e),
z AS (SELECT count(*) AS diagnostics, count(DISTINCT CASE WHEN code = 'parse_error' AND file <> '' THEN file END) AS parse_error_file_count FROM d)
SELECT nodes, edges, diagnostics, CAST(bad AS DOUBLE) / edges AS unresolved_or_unsupported_edge_rate, CAST(diagnostics AS DOUBLE) / nodes AS diagnostics_per_node, parse_error_file_count FROM x, y, z""")
def report_rates(s: SparkSession, d: str) -> DataFrame:
    return report.rates(trade.graph(s, d))


# --- validation


@_query("SELECT o_orderkey AS item, 'order without lines' AS rule FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
def dangling_orders(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"))
    return validate.dangling(table(s, d, "orders"), "o_orderkey", lines, "order without lines", "o_orderkey")


@_query(f"WITH {_E} SELECT 'edge.id is duplicate' AS rule, id AS item FROM e GROUP BY id HAVING count(*) > 1")
def contract_violations(s: SparkSession, d: str) -> DataFrame:
    """All rules together: line numbers repeat within orders, and nothing else is wrong."""
    return validate.violations(trade.graph(s, d))


# --- search and listings


@_query(f"WITH {_N} SELECT id, qualified_name FROM n WHERE contains(lower(concat_ws(chr(10), id, qualified_name, display_name, coalesce(file, ''))), '00011') ORDER BY id LIMIT 80")
def contains_search(s: SparkSession, d: str) -> DataFrame:
    return search.search(trade.nodes(s, d), "00011").select("id", "qualified_name")


@_query("SELECT doc_id FROM documents WHERE contains(lower(text), 'ertion') ORDER BY doc_id LIMIT 80")
def text_search(s: SparkSession, d: str) -> DataFrame:
    return search.holding(table(s, d, "documents").select("doc_id", "text"), F.col("text"), "ertion", "doc_id").select("doc_id")


@_query(f"""WITH {_N}, f AS (SELECT id, qualified_name FROM n WHERE (language IS NULL OR language IN ('building', 'machinery')) AND contains(lower(concat_ws(' ', id, qualified_name, display_name, coalesce(file, ''))), 'customer') ORDER BY id LIMIT 81)
SELECT id, qualified_name, (SELECT count(*) FROM f) > 80 AS truncated FROM f ORDER BY id LIMIT 80""")
def viewer_search(s: SparkSession, d: str) -> DataFrame:
    return search.search_page(trade.nodes(s, d), "CUSTOMER", languages=["building", "machinery"]).select("id", "qualified_name", "truncated")


@_query("""WITH t AS (SELECT doc_id AS ordinal, unnest(list_distinct(string_split(lower(text), ''))) AS character FROM documents)
SELECT character, count(*) AS n, min(ordinal) AS first, max(ordinal) AS last, concat('u', lower(to_hex(unicode(character)))) AS key FROM t WHERE trim(character) <> '' GROUP BY character""")
def char_postings(s: SparkSession, d: str) -> DataFrame:
    return search.postings(table(s, d, "documents").select(F.col("doc_id").alias("ordinal"), F.lower("text").alias("text")))


@_query(f"WITH {_D} SELECT code, severity, message, file, CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS rank FROM d ORDER BY rank, file, code, message LIMIT 200")
def severity_top(s: SparkSession, d: str) -> DataFrame:
    return search.top_diagnostics(trade.diagnostics(s, d)).select("code", "severity", "message", "file", "rank")


@_query(f"WITH {_N} SELECT id, qualified_name FROM n ORDER BY qualified_name, id LIMIT 300")
def table_of_contents(s: SparkSession, d: str) -> DataFrame:
    return search.contents(trade.nodes(s, d)).select("id", "qualified_name")


@_query(f"""WITH {_N}, {_E}, h AS (SELECT source_id, target_id FROM e WHERE source_id = 's7' OR target_id = 's7')
SELECT id, kind FROM n WHERE id = 's7' OR id IN (SELECT source_id FROM h) OR id IN (SELECT target_id FROM h)""")
def node_neighbourhood(s: SparkSession, d: str) -> DataFrame:
    return search.neighbourhood(trade.nodes(s, d), trade.edges(s, d), "s7")[0].select("id", "kind")


@_query(f"""WITH {_N}, {_E}, v AS (SELECT id FROM n WHERE language IS NULL OR language IN ('python', 'building'))
SELECT id, relation_type FROM e WHERE source_id IN (SELECT id FROM v) AND target_id IN (SELECT id FROM v)""")
def visible_edges(s: SparkSession, d: str) -> DataFrame:
    return search.visible(trade.nodes(s, d), trade.edges(s, d), ["python", "building"])[1].select("id", "relation_type")


@_query("SELECT c_custkey FROM customer WHERE c_nationkey BETWEEN 5 AND 15 AND c_acctbal BETWEEN 100 AND 3000")
def in_viewport(s: SparkSession, d: str) -> DataFrame:
    at = table(s, d, "customer").withColumns({"x": F.col("c_nationkey"), "y": F.col("c_acctbal")})
    return at.where(scalars.inside(F.col("x"), F.col("y"), 10, 1550, 5, 1450)).select("c_custkey")


# --- set operations


@_query("""SELECT l_partkey, l_suppkey, abs(n) AS n, CASE WHEN n > 0 THEN 'missing' ELSE 'extra' END AS side FROM (
  SELECT l_partkey, l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE -1 END) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2) WHERE n <> 0""")
def multiset_diff(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem")
    part = lambda f: rows.where(F.col("l_returnflag") == f).select("l_partkey", "l_suppkey")
    return merge.difference(part("A"), part("R"))


@_query("SELECT DISTINCT c_mktsegment AS id FROM customer GROUP BY c_mktsegment, c_nationkey HAVING count(*) > 0 AND (SELECT count(DISTINCT c_nationkey) FROM customer c WHERE c.c_mktsegment = customer.c_mktsegment) > 1")
def union_conflicts(s: SparkSession, d: str) -> DataFrame:
    return merge.conflicts(table(s, d, "customer").select(F.col("c_mktsegment").alias("id"), "c_nationkey"))


@_query(f"""WITH {_N}, {_E}, a AS (SELECT concat('manual:', n_name) AS id, 'external' AS kind, n_name AS qualified_name, 'unknown' AS visibility FROM nation)
SELECT id, kind, qualified_name, visibility FROM n UNION ALL SELECT * FROM a""")
def overlay_merge(s: SparkSession, d: str) -> DataFrame:
    hand = table(s, d, "nation").select(F.concat(F.lit("manual:"), "n_name").alias("id"), F.col("n_name").alias("label"), F.lit("external").alias("kind"))
    base = trade.graph(s, d)
    return merge.merge_overlay(base, hand, base.edges.limit(0).drop("provenance")).nodes.select("id", "kind", "qualified_name", "visibility")


# --- resolution


@_query("""WITH r AS (SELECT p_partkey AS ref, unnest([concat('a.', p_brand), concat('b.', p_type)]) AS name FROM part),
d AS (SELECT concat('a.', p_brand) AS name, p_size AS target FROM part WHERE p_size < 3 UNION ALL SELECT concat('c.', p_type), p_size FROM part WHERE p_size = 50),
f AS (SELECT ref, count(DISTINCT target) AS n, min(target) AS t FROM r JOIN d USING (name) GROUP BY ref),
g AS (SELECT ref, count(DISTINCT d.target) AS n, min(d.target) AS t FROM r JOIN d ON split_part(r.name, '.', -1) = split_part(d.name, '.', -1) WHERE ref NOT IN (SELECT ref FROM f) GROUP BY ref),
u AS (SELECT *, 'name' AS how FROM f UNION ALL SELECT *, 'short name' FROM g)
SELECT p_partkey AS ref, coalesce(n, 0) AS candidates, CASE WHEN n = 1 THEN t END AS target_id, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'unresolved' ELSE 'external' END AS status, how FROM part LEFT JOIN u ON p_partkey = ref""")
def resolve_cascade(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part")
    refs = part.select(F.col("p_partkey").alias("ref"), F.array(F.concat(F.lit("a."), "p_brand"), F.concat(F.lit("b."), "p_type")).alias("names"))
    defs = part.where("p_size < 3").select(F.concat(F.lit("a."), "p_brand").alias("name"), F.col("p_size").alias("target")).union(part.where("p_size = 50").select(F.concat(F.lit("c."), "p_type"), "p_size"))
    return resolve.cascade(refs, defs)


@_query("""SELECT e.event_id AS ref, CASE WHEN e.event_id % 3 = 0 THEN CASE WHEN n1.n_nationkey IS NOT NULL THEN mod ELSE concat('module:', mod) END WHEN n1.n_nationkey IS NOT NULL AND r.r_regionkey IS NOT NULL THEN concat('s', r.r_regionkey) ELSE concat('symbol:', mod, '.', member) END AS target_id,
  CASE WHEN e.event_id % 3 = 0 AND n1.n_nationkey IS NOT NULL OR e.event_id % 3 <> 0 AND n1.n_nationkey IS NOT NULL AND r.r_regionkey IS NOT NULL THEN 'resolved' ELSE 'external' END AS status
FROM (SELECT *, concat('m', user_id % 40) AS mod, CASE WHEN event_id % 3 <> 0 THEN concat('k', event_id % 9) END AS member FROM events) e
LEFT JOIN nation n1 ON mod = concat('m', n1.n_nationkey) LEFT JOIN region r ON member = concat('k', r.r_regionkey) AND n1.n_regionkey = r.r_regionkey""")
def resolve_imports(s: SparkSession, d: str) -> DataFrame:
    asked = table(s, d, "events").select(F.col("event_id").alias("ref"), F.concat(F.lit("m"), F.col("user_id") % 40).alias("module_name"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("k"), F.col("event_id") % 9)).alias("member"))
    name = F.concat(F.lit("m"), "n_nationkey")
    modules = table(s, d, "nation").select(name.alias("module_name"), name.alias("id"))
    symbols = table(s, d, "nation").select(name.alias("module_id"), F.concat(F.lit("k"), "n_regionkey").alias("name"), F.concat(F.lit("s"), "n_regionkey").alias("id"))
    return resolve.bind_imports(asked, modules, symbols)


@_query("""WITH d AS (SELECT lower(p_brand) AS k, min(p_partkey) AS target_id FROM part GROUP BY 1) SELECT p_partkey AS ref, target_id FROM part LEFT JOIN d ON lower(replace(p_brand, '1', '2')) = k""")
def first_definition(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part")
    refs = part.select(F.col("p_partkey").alias("ref"), F.upper(F.replace("p_brand", F.lit("1"), F.lit("2"))).alias("name"))
    defs = part.select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("target"))
    return resolve.first_definition(refs, defs, ["target"]).select("ref", "target_id")


@_query("""SELECT p_partkey AS ref, CASE WHEN p_size % 4 = 0 THEN concat(p_size, '.ts') WHEN p_size % 2 = 0 THEN concat(p_size, '/index.js') END AS path FROM part""")
def first_path(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part")
    size = F.col("p_size").cast("string")
    refs = part.select(F.col("p_partkey").alias("ref"), F.array(F.concat(F.lit("../"), size), F.concat(size, F.lit(".ts")), F.concat(size, F.lit("/index.js"))).alias("candidates"))
    files = part.where("p_size % 4 = 0").select(F.concat(size, F.lit(".ts")).alias("path")).union(part.where("p_size % 2 = 0").select(F.concat(size, F.lit("/index.js")))).union(part.select(F.concat(F.lit("../"), size))).distinct()
    return resolve.first_path(refs, files)


@_query("""SELECT e.event_id AS ref, e.user_id, e.event_id AS at, max(v.event_id) AS scope_id FROM events e LEFT JOIN events v ON v.event_type = 'view' AND v.user_id = e.user_id AND v.event_id <= e.event_id WHERE e.event_type = 'click' GROUP BY ALL""")
def last_started_scope(s: SparkSession, d: str) -> DataFrame:
    ev = table(s, d, "events")
    points = ev.where("event_type = 'click'").select(F.col("event_id").alias("ref"), "user_id", F.col("event_id").alias("at"))
    scopes = ev.where("event_type = 'view'").select("user_id", F.col("event_id").alias("start"), F.col("event_id").alias("scope_id"))
    return resolve.last_started(points, scopes, "user_id")


@_query("""WITH sc AS (SELECT l_orderkey AS k, l_linenumber AS s, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber + 2 END AS e, l_partkey AS scope_id FROM lineitem WHERE l_linenumber <> 3)
SELECT p.l_orderkey, p.l_linenumber AS ref, p.l_linenumber AS at, arg_max(scope_id, s * 100000000 + scope_id) AS scope_id FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) p LEFT JOIN sc ON k = p.l_orderkey AND s <= p.l_linenumber AND (e IS NULL OR e > p.l_linenumber) GROUP BY 1, 2, 3""")
def enclosing_scope(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    points = li.select("l_orderkey", F.col("l_linenumber").alias("ref"), F.col("l_linenumber").alias("at")).distinct()
    scopes = li.where("l_linenumber <> 3").select("l_orderkey", F.col("l_linenumber").alias("start"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") + 2).alias("end"), F.col("l_partkey").alias("scope_id"))
    return resolve.enclosing(points, scopes, "l_orderkey")


@_query("SELECT conv_id, turn AS before, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations QUALIFY after IS NOT NULL")
def pipeline_pairs(s: SparkSession, d: str) -> DataFrame:
    return resolve.adjacent_pairs(table(s, d, "conversations"), "conv_id", "turn", "turn")


@_query("""WITH RECURSIVE p AS (SELECT p_partkey AS child, CAST(round(p_partkey / 3) AS BIGINT) AS parent FROM part WHERE p_partkey > 2),
a AS (SELECT p_partkey AS own, p_partkey AS place, 0 AS depth FROM part UNION ALL SELECT a.own, p.parent, a.depth + 1 FROM a JOIN p ON a.place = p.child WHERE a.depth < 20),
h AS (SELECT own, depth, p_size AS target FROM a JOIN part ON place = p_partkey WHERE p_size < 5),
b AS (SELECT own, min(depth) AS depth FROM h GROUP BY own),
g AS (SELECT h.own, count(DISTINCT target) AS n, min(target) AS t FROM h JOIN b ON h.own = b.own AND h.depth = b.depth GROUP BY h.own)
SELECT p_partkey AS ref, coalesce(n, 0) AS candidates, CASE WHEN n = 1 THEN t END AS target_id FROM part LEFT JOIN g ON p_partkey = own""")
def owner_members(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part")
    owners = part.select(F.col("p_partkey").alias("ref"), F.col("p_partkey").alias("owner"), F.lit("size").alias("name"))
    parents = part.where("p_partkey > 2").select(F.col("p_partkey").alias("child"), F.round(F.col("p_partkey") / 3).cast("long").alias("parent"))
    members = part.where("p_size < 5").select(F.col("p_partkey").alias("owner"), F.lit("size").alias("name"), F.col("p_size").alias("target"))
    return resolve.owner_members(owners, parents, members, nearest=True)


# --- whole tables: the operators of queries above whose SQL takes a part of its rows, over all rows and with their own limits


@_query(f"""WITH RECURSIVE {_N}, a AS (SELECT id, id AS ancestor, 0 AS depth FROM n UNION ALL SELECT a.id, n.parent_id, a.depth + 1 FROM a JOIN n ON a.ancestor = n.id WHERE n.parent_id IS NOT NULL)
SELECT id, ancestor, depth FROM a""")
def containment_closure_whole(s: SparkSession, d: str) -> DataFrame:
    return rollup.ancestors(trade.nodes(s, d))


@_query(f"""WITH {_N}, {_E}, x AS (SELECT id, source_id, CASE WHEN confidence >= 0.09 THEN concat(target_id, 'x') ELSE target_id END AS target_id FROM e)
SELECT 'edge.target_id does not exist' AS rule, x.id AS item FROM x ANTI JOIN n ON x.target_id = n.id
UNION ALL SELECT 'edge.source_id does not exist', x.id FROM x ANTI JOIN n ON x.source_id = n.id""")
def dangling_edges_whole(s: SparkSession, d: str) -> DataFrame:
    known, e = trade.nodes(s, d), trade.edges(s, d)
    e = e.withColumn("target_id", F.when(F.col("confidence") >= 0.09, F.concat("target_id", F.lit("x"))).otherwise(F.col("target_id")))
    return validate.dangling(e, "target_id", known, "edge.target_id does not exist").union(validate.dangling(e, "source_id", known, "edge.source_id does not exist"))


@_query("""WITH RECURSIVE p AS (SELECT p_partkey AS id, (p_partkey * 7 + 3) % 100 AS up FROM part),
a AS (SELECT id, up, 1 AS depth FROM p UNION ALL SELECT a.id, p.up, depth + 1 FROM a JOIN p ON a.up = p.id WHERE depth < 45)
SELECT DISTINCT id FROM a WHERE depth = 45""")
def parent_cycles_whole(s: SparkSession, d: str) -> DataFrame:
    return validate.on_parent_cycles(table(s, d, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 7 + 3) % 100).alias("parent_id")))


@_query("SELECT l_orderkey AS id, 'line.id is duplicate' AS rule FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def duplicate_ids_whole(s: SparkSession, d: str) -> DataFrame:
    return validate.duplicates(table(s, d, "lineitem").select(F.col("l_orderkey").alias("id")), "line.id is duplicate").withColumnRenamed("item", "id")


@_query(f"""WITH {_E}, r AS (SELECT *, CASE WHEN source_id = 'c11' OR target_id = 's7' THEN 0 WHEN relation_type = 'imports' THEN 1 ELSE 2 END AS priority FROM e)
SELECT id, priority, (SELECT greatest(count(*) - 24000, 0) FROM e) AS omitted FROM r ORDER BY priority, id LIMIT 24000""")
def drawn_edges_whole(s: SparkSession, d: str) -> DataFrame:
    e = trade.edges(s, d)
    return search.drawn_edges(e, (F.col("source_id") == "c11") | (F.col("target_id") == "s7"), F.col("relation_type") == "imports").select("id", "priority", "omitted")


@_query("""WITH c AS (SELECT s_nationkey AS k, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS one FROM supplier GROUP BY 1)
SELECT c_custkey AS ref, coalesce(n, 0) AS candidates, CASE WHEN n = 1 THEN one END AS target_id, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'unresolved' ELSE 'external' END AS status FROM customer LEFT JOIN c ON c_nationkey = k""")
def resolve_unique_whole(s: SparkSession, d: str) -> DataFrame:
    refs = table(s, d, "customer").select(F.col("c_custkey").alias("ref"), F.col("c_nationkey").alias("name"))
    return resolve.unique_match(refs, table(s, d, "supplier").select(F.col("s_nationkey").alias("name"), F.col("s_suppkey").alias("target")), ["name"]).drop("name")


@_query(f"""WITH {_N}, b AS (SELECT concat('n', n_nationkey) AS scope, concat('x', n_nationkey % 2) AS name, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END AS target FROM nation
  UNION ALL SELECT concat('r', r_regionkey), concat('x', r_regionkey % 2), r_name FROM region),
q AS (SELECT x.id AS ref, x.id AS scope, concat('x', length(x.id) % 2) AS name, x.parent_id AS p1, p.parent_id AS p2 FROM n x LEFT JOIN n p ON x.parent_id = p.id)
SELECT ref, q.scope, q.name, coalesce(o.scope, u.scope, v.scope) AS bound_in, CASE WHEN o.scope IS NOT NULL THEN o.target WHEN u.scope IS NOT NULL THEN u.target ELSE v.target END AS target_id,
  CASE WHEN coalesce(o.scope, u.scope, v.scope) IS NULL THEN 'unbound' WHEN CASE WHEN o.scope IS NOT NULL THEN o.target WHEN u.scope IS NOT NULL THEN u.target ELSE v.target END IS NULL THEN 'unresolved' ELSE 'resolved' END AS status
FROM q LEFT JOIN b o ON o.scope = q.scope AND o.name = q.name LEFT JOIN b u ON u.scope = p1 AND u.name = q.name LEFT JOIN b v ON v.scope = p2 AND v.name = q.name""")
def resolve_lexical_whole(s: SparkSession, d: str) -> DataFrame:
    nodes = trade.nodes(s, d)
    refs = nodes.select(F.col("id").alias("ref"), F.col("id").alias("scope"), F.concat(F.lit("x"), F.length("id") % 2).alias("name"))
    bind = lambda df, p, k, t: df.select(F.concat(F.lit(p), k).alias("scope"), F.concat(F.lit("x"), F.col(k) % 2).alias("name"), t.alias("target"), F.lit(False).alias("is_import"))
    nations = bind(table(s, d, "nation"), "n", "n_nationkey", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")))
    return resolve.lexical(refs, nodes, nations.union(bind(table(s, d, "region"), "r", "r_regionkey", F.col("r_name"))))


# --- scalars and extraction


@_query("SELECT doc_id, sha256(text) AS sha256, substr(sha1(text), 1, 16) AS sha1_16, length(text) AS chars FROM documents")
def digest_ids(s: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(s, d, "documents").select("doc_id", scalars.digest(text).alias("sha256"), scalars.digest(text, 160, 16).alias("sha1_16"), F.length(text).cast("long").alias("chars"))


@_query("""SELECT doc_id, length(p) - length(replace(p, chr(10), '')) + 1 AS line, strlen(list_last(string_split(p, chr(10)))) AS col FROM (SELECT doc_id, left(text, 700) AS p FROM documents)""")
def offset_positions(s: SparkSession, d: str) -> DataFrame:
    line, col = scalars.position_of(F.col("text"), 700)
    return table(s, d, "documents").select("doc_id", line.cast("long").alias("line"), col.cast("long").alias("col"))


@_query("""WITH t AS (
  SELECT p_partkey, p_type, concat(CASE WHEN p_size % 3 = 0 THEN '_' WHEN p_size % 3 = 1 THEN '-' ELSE '' END, p_brand) AS name, ['python', 'go', 'lua', 'java'][p_size % 4 + 1] AS language, ['', 'public final', 'private', 'fileprivate', 'openly'][p_size % 5 + 1] AS modifiers FROM part)
SELECT p_partkey, CASE language WHEN 'java' THEN CASE WHEN regexp_matches(modifiers, '\\b(private|protected|fileprivate)\\b') THEN 'private' WHEN regexp_matches(modifiers, '\\b(public|open)\\b') THEN 'public' ELSE 'unknown' END
  WHEN 'go' THEN CASE WHEN left(name, 1) BETWEEN 'A' AND 'Z' THEN 'public' ELSE 'private' END
  WHEN 'lua' THEN CASE WHEN left(name, 1) IN ('_', '-') THEN 'private' ELSE 'public' END
  ELSE CASE WHEN starts_with(name, '_') THEN 'private' ELSE 'public' END END AS visibility,
  CASE WHEN length(p_type) > 12 THEN concat(left(p_type, 11), '…') ELSE p_type END AS shown FROM t""")
def visibility_and_labels(s: SparkSession, d: str) -> DataFrame:
    lead = F.when(F.col("p_size") % 3 == 0, "_").when(F.col("p_size") % 3 == 1, "-").otherwise("")
    language = F.element_at(F.array(*map(F.lit, ("python", "go", "lua", "java"))), (F.col("p_size") % 4 + 1).cast("int"))
    modifiers = F.element_at(F.array(*map(F.lit, ("", "public final", "private", "fileprivate", "openly"))), (F.col("p_size") % 5 + 1).cast("int"))
    shown = display.shortened(F.col("p_type"), 12)
    return table(s, d, "part").select("p_partkey", scalars.visibility(F.concat(lead, "p_brand"), language, modifiers).alias("visibility"), shown.alias("shown"))


@_query("""WITH t AS (SELECT c_custkey, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y, least(greatest(((c_acctbal - 100) * 3 + (c_nationkey - 2) * 4) / CAST(25 AS DOUBLE), 0), 1) AS t FROM customer)
SELECT c_custkey, t, sqrt((x - (100 + t * 3)) * (x - (100 + t * 3)) + (y - (2 + t * 4)) * (y - (2 + t * 4))) AS distance FROM t""")
def segment_distance(s: SparkSession, d: str) -> DataFrame:
    t, far = scalars.to_segment(F.col("c_acctbal"), F.col("c_nationkey").cast("double"), 100, 2, 103, 6)
    return table(s, d, "customer").select("c_custkey", t.alias("t"), far.alias("distance"))


def _elements(s: SparkSession, d: str) -> DataFrame:
    return web.elements(table(s, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.encode("html", "utf-8").alias("content")))


@_query("SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages) GROUP BY page_id, tag")
def html_elements(s: SparkSession, d: str) -> DataFrame:
    return _elements(s, d).groupBy(F.col("file").cast("long").alias("page_id"), "tag").agg(F.count(F.lit(1)).alias("n"))


@_query("""WITH s(selector, pattern) AS (VALUES ('article', '<article[ >]'), ('LI', '<li[ >]'), ('.ad', 'class="ad"'), ('#none', ' id="none"'), ('p > b', '<no match>')),
x AS (SELECT selector, page_id, len(regexp_extract_all(html, pattern)) AS n FROM pages, s)
SELECT selector, CASE WHEN contains(selector, '>') THEN 'unsupported' WHEN sum(n) = 0 THEN 'unresolved' ELSE 'resolved' END AS status, CAST(sum(n) AS BIGINT) AS elements, count(CASE WHEN n > 0 THEN 1 END) AS files FROM x GROUP BY selector""")
def html_references(s: SparkSession, d: str) -> DataFrame:
    asked = s.createDataFrame([(i, x) for i, x in enumerate(("article", "LI", ".ad", "#none", "p > b"))], "ref int, selector string")
    found = web_joins.matches(asked, _elements(s, d))
    return found.groupBy("selector", "status").agg(F.count("element").alias("elements"), F.count_distinct("element_file").alias("files"))


# --- bundles


def _ordered(s: SparkSession, d: str) -> DataFrame:
    return rollup.chunked(trade.nodes(s, d), 2000)


_RECORDS = f"""WITH {_N}, {_M}, r AS (SELECT row_number() OVER (ORDER BY n.id) - 1 AS ordinal, n.id, kind, qualified_name, display_name, file, language, module_id AS module FROM n JOIN m ON n.id = m.id)"""


@_query(f"{_RECORDS} SELECT * FROM r")
def search_records(s: SparkSession, d: str) -> DataFrame:
    return bundle.records(_ordered(s, d), _modules(s, d))


@_query(f"""{_RECORDS}, f AS (SELECT id, ordinal FROM r WHERE contains(lower(concat_ws(chr(10), id, qualified_name, display_name, coalesce(file, ''))), 'r#00') ORDER BY ordinal LIMIT 80) SELECT id, ordinal FROM f""")
def bundle_search(s: SparkSession, d: str) -> DataFrame:
    found = bundle.records(_ordered(s, d), _modules(s, d))
    return bundle.candidates(found, bundle._postings(found, 5000), " R#00").select("id", "ordinal")


@_query(f"""{_RECORDS}, {_E}, g AS (
  SELECT s.module_id AS sm, t.module_id AS tm, relation_type, resolution_status, count(*) AS count, min(confidence) AS min_confidence, max(confidence) AS max_confidence, min(e.id) AS representative_edge_id
  FROM e JOIN m s ON e.source_id = s.id JOIN m t ON e.target_id = t.id WHERE s.module_id <> t.module_id GROUP BY ALL)
SELECT substr(sha1(concat(sm, chr(31), tm, chr(31), relation_type, chr(31), resolution_status)), 1, 20) AS group_id, coalesce(a.ordinal, -1) AS source_ordinal, coalesce(b.ordinal, -1) AS target_ordinal,
  CASE WHEN a.id IS NULL THEN sm END AS source_virtual, CASE WHEN b.id IS NULL THEN tm END AS target_virtual, relation_type, resolution_status, count, min_confidence, max_confidence, representative_edge_id
FROM g LEFT JOIN r a ON sm = a.id LEFT JOIN r b ON tm = b.id""")
def compact_groups(s: SparkSession, d: str) -> DataFrame:
    return bundle.compact_groups(rollup.edge_groups(_edges_in_modules(s, d)), _ordered(s, d))


@_query(f"""{_RECORDS} SELECT module AS module_id, list_sort(list_distinct(list(CAST(ordinal // 2000 AS INTEGER)))) AS chunks FROM r GROUP BY module""")
def module_chunk_sets(s: SparkSession, d: str) -> DataFrame:
    modules = _modules(s, d)
    placed = modules.join(_ordered(s, d).select("id", "chunk"), "id")
    return rollup.chunk_sets(modules.select("module_id").distinct(), placed, "module_id")


# --- display


@_query(f"""WITH {_N}, w AS (SELECT greatest(1, CAST(ceil(sqrt(count(*))) AS BIGINT)) AS width FROM n WHERE kind = 'module'),
g AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM n WHERE kind = 'module'),
x AS (SELECT id, kind, parent_id, CASE WHEN parent_id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY parent_id ORDER BY id) - 1 END AS sibling,
  list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), list_transform(string_split(id, ''), lambda c: CAST(unicode(c) AS UBIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM n)
SELECT id, CAST(NULL AS VARCHAR) AS parent_id, CAST(NULL AS BIGINT) AS sibling, CAST(NULL AS BIGINT) AS angle, CAST(NULL AS BIGINT) AS radius, k % width AS "column", k // width AS "row" FROM g, w
UNION ALL SELECT id, parent_id, sibling, CAST(h % 360 AS BIGINT), 150 + (sibling % 5) * 34, NULL, NULL FROM x WHERE kind <> 'module'""")
def layout_places(s: SparkSession, d: str) -> DataFrame:
    return display.places(trade.nodes(s, d))


@_query(f"WITH {_N} SELECT id, coalesce(nullif(language, ''), CASE WHEN id LIKE 'r1%' THEN 'indexed' END, 'java') AS language FROM n")
def node_languages(s: SparkSession, d: str) -> DataFrame:
    indexed = F.when(F.col("id").like("r1%"), "indexed")
    return trade.nodes(s, d).select("id", display.language_of(F.col("extensions"), F.col("language"), indexed, "java").alias("language"))


@_query(f"WITH {_N} SELECT id, coalesce(CASE WHEN kind = 'module' THEN nullif(file, '') END, nullif(display_name, ''), nullif(qualified_name, ''), id) AS label FROM n")
def node_labels(s: SparkSession, d: str) -> DataFrame:
    return trade.nodes(s, d).select("id", display.label(*map(F.col, ("kind", "file", "display_name", "qualified_name", "id"))).alias("label"))


@_query("""WITH e AS (SELECT c_custkey AS id, CAST(c_nationkey AS DOUBLE) * 10 AS x1, c_acctbal / 10 AS y1 FROM customer), t AS (SELECT id, least(greatest((30 * (125 - x1) + 40 * (300 - y1)) / 2500, 0), 1) AS t, x1, y1 FROM e),
f AS (SELECT id, sqrt((125 - x1 - t * 30) * (125 - x1 - t * 30) + (300 - y1 - t * 40) * (300 - y1 - t * 40)) AS distance FROM t)
SELECT id FROM f WHERE distance < 200 ORDER BY distance, id LIMIT 1""")
def nearest_edge(s: SparkSession, d: str) -> DataFrame:
    x, y = F.col("c_nationkey").cast("double") * 10, F.col("c_acctbal") / 10
    edges = table(s, d, "customer").select(F.col("c_custkey").alias("id"), x.alias("x1"), y.alias("y1"), (x + 30).alias("x2"), (y + 40).alias("y2"))
    return display.hit_edge(edges, 125.0, 300.0, 200.0).select("id")


# --- inference


@_query("""WITH p AS (SELECT p_brand AS base, p_type AS folder, CASE WHEN p_size % 2 = 0 THEN 'pkg' ELSE 'pkg_test' END AS package, p_partkey FROM part),
g AS (SELECT folder, package, base, count(*) AS n_files FROM p GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ends_with(package, '_test'), package, folder) AS k FROM g)
SELECT folder, package, base, n_files, CASE WHEN k = 1 THEN base ELSE concat(base, '#', package) END AS import_path FROM o""")
def go_packages(s: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_size") % 2 == 0, "pkg").otherwise("pkg_test")
    return packages.go_packages(table(s, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_type").alias("folder"), name.alias("package"), F.col("p_brand").alias("base")))


@_query("""WITH v AS (SELECT s_nationkey AS scope, s_suppkey % 7 AS name, min(s_suppkey % 3) AS type FROM supplier GROUP BY ALL HAVING count(DISTINCT s_suppkey % 3) = 1)
SELECT c_custkey AS ref, coalesce(CAST(a.type AS VARCHAR), CAST(b.type AS VARCHAR), CASE WHEN c_custkey % 7 = 5 THEN '5' END) AS owner,
  CASE WHEN a.type IS NOT NULL THEN 'variable' WHEN b.type IS NOT NULL THEN 'field' WHEN c_custkey % 7 = 5 THEN 'type' ELSE 'unknown' END AS how
FROM customer LEFT JOIN v a ON a.scope = c_nationkey AND a.name = c_custkey % 7 LEFT JOIN v b ON b.scope = (c_nationkey + 1) % 25 AND b.name = c_custkey % 7""")
def receiver_types(s: SparkSession, d: str) -> DataFrame:
    text = lambda c: c.cast("string")
    calls = table(s, d, "customer").select(F.col("c_custkey").alias("ref"), text(F.col("c_nationkey")).alias("caller"), text((F.col("c_nationkey") + 1) % 25).alias("caller_owner"), text(F.col("c_custkey") % 7).alias("receiver"))
    variables = table(s, d, "supplier").select(text(F.col("s_nationkey")).alias("scope"), text(F.col("s_suppkey") % 7).alias("name"), text(F.col("s_suppkey") % 3).alias("type"))
    return infer.receiver_types(calls, variables, s.createDataFrame([("5",)], "name string")).select("ref", "owner", "how")


@_query("""WITH k AS (SELECT s_nationkey AS key, count(DISTINCT s_suppkey) AS n, min(s_name) AS target FROM supplier GROUP BY s_nationkey)
SELECT c_custkey AS ref, CASE WHEN n = 1 THEN target END AS target_id, CASE WHEN n = 1 THEN 'resolved' ELSE 'unresolved' END AS status FROM customer LEFT JOIN k ON c_nationkey = key""")
def global_names(s: SparkSession, d: str) -> DataFrame:
    one = lambda t, key, n: table(s, d, t).select(F.lit("lua").alias("language"), F.col(key).cast("string").alias("name"), F.col(n))
    refs = one("customer", "c_nationkey", "c_custkey").withColumnRenamed("c_custkey", "ref")
    return infer.global_names(refs, one("supplier", "s_nationkey", "s_name").withColumnRenamed("s_name", "target")).select("ref", "target_id", "status")


@_query(f"""WITH {_N}, {_E}, x AS (SELECT id, qualified_name FROM n WHERE kind IN ('module', 'class', 'function'))
SELECT relation_type, a.qualified_name AS source, b.qualified_name AS target, count(*) AS n FROM e JOIN x a ON source_id = a.id JOIN x b ON target_id = b.id WHERE resolution_status = 'resolved' GROUP BY ALL""")
def relation_counts(s: SparkSession, d: str) -> DataFrame:
    named = trade.nodes(s, d).withColumn("file", F.when(F.col("kind").isin("module", "class", "function"), F.lit("f")))
    return packages.relation_counts(trade.edges(s, d), named)


# --- rules, types as files see them, and whole sources made from the tables

_LANGS, _RELS = ("java", "ruby", "javascript", "scala", "vbnet", "python", "css", "shell", "rust", "go"), ("calls", "imports", "inherits", "uses", "styles", "handles")
_VALUES = ", ".join(f"('{a}', '{b}', '{c}', CAST({x} AS DOUBLE))" for a, b, c, x in rules.rows())


@_query(f"""WITH o AS (
  SELECT list_extract({list(_LANGS)}, CAST(l_suppkey % {len(_LANGS)} AS INTEGER) + 1) AS language, list_extract({list(_RELS)}, CAST(l_linenumber % {len(_RELS)} AS INTEGER) + 1) AS relation_type,
         CASE l_returnflag WHEN 'A' THEN 'resolved' WHEN 'N' THEN 'external' ELSE 'unresolved' END AS resolution_status FROM lineitem),
r(l, r, s, c) AS (VALUES {_VALUES})
SELECT language, relation_type, resolution_status, count(*) AS count, coalesce(any_value(x.c), any_value(y.c)) AS confidence
FROM o LEFT JOIN r x ON x.l = language AND x.r = relation_type AND x.s = resolution_status LEFT JOIN r y ON y.l = '*' AND y.s = resolution_status GROUP BY ALL""")
def confidence_rules(s: SparkSession, d: str) -> DataFrame:
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % len(names) + 1).cast("int"))
    status = F.when(F.col("l_returnflag") == "A", "resolved").when(F.col("l_returnflag") == "N", "external").otherwise("unresolved")
    o = table(s, d, "lineitem").select(pick(_LANGS, "l_suppkey").alias("language"), pick(_RELS, "l_linenumber").alias("relation_type"), status.alias("resolution_status"))
    counted = o.groupBy("language", "relation_type", "resolution_status").agg(F.count(F.lit(1)).alias("count"))
    return rules.with_confidence(counted)


@_query("""WITH t AS (SELECT concat('f', s_suppkey * 10) AS file, concat('n', s_nationkey) AS package, concat('S', s_suppkey % 7) AS name, concat('n', s_nationkey, '.S', s_suppkey % 7) AS qualified, concat('s', s_suppkey) AS target FROM supplier),
a AS (SELECT c_custkey, c_nationkey, concat('f', c_custkey) AS file, concat('S', c_custkey % 9) AS name FROM customer),
u AS (
  SELECT file, name, 0 AS step, target FROM a JOIN t USING (file, name) UNION ALL
  SELECT a.file, a.name, 1, target FROM a JOIN t ON qualified = concat('n', (c_nationkey + 1) % 25, '.', a.name) WHERE c_custkey % 3 = 0 UNION ALL
  SELECT a.file, a.name, 2, target FROM a JOIN t ON package = concat('n', c_nationkey) AND t.name = a.name UNION ALL
  SELECT a.file, a.name, 3, target FROM a JOIN t ON package = concat('n', (c_nationkey + 2) % 25) AND t.name = a.name WHERE c_custkey % 3 = 1 UNION ALL
  SELECT a.file, a.name, 4, target FROM a JOIN t USING (name)),
g AS (SELECT file, name, step, count(DISTINCT target) AS n, min(target) AS target FROM u GROUP BY ALL),
b AS (SELECT file, name, arg_min(n, step) AS n, arg_min(target, step) AS target, arg_min(['file', 'import', 'package', 'whole import', 'name'][step + 1], step) AS how FROM g GROUP BY ALL)
SELECT file, name, coalesce(n, 0) AS candidates, CASE WHEN n = 1 THEN target END AS target_id, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'unresolved' ELSE 'external' END AS status, how FROM a LEFT JOIN b USING (file, name)""")
def type_names(s: SparkSession, d: str) -> DataFrame:
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    key, nation, java = F.col("c_custkey"), F.col("c_nationkey"), F.lit("java").alias("language")
    name = text("S", F.col("s_suppkey") % 7)
    package = text("n", F.col("s_nationkey"))
    types = table(s, d, "supplier").select(java, text("f", F.col("s_suppkey") * 10).alias("file"), package.alias("package"), name.alias("name"), F.concat(package, F.lit("."), name).alias("qualified"), text("s", F.col("s_suppkey")).alias("target"))
    c = table(s, d, "customer").withColumns({"file": text("f", key), "name": text("S", key % 9)})
    path = F.when(key % 3 == 0, text("n", (nation + 1) % 25, ".", F.col("name"))).when(key % 3 == 1, text("n", (nation + 2) % 25, ".*"))
    imports = c.select(java, "file", path.alias("path"), F.lit(None).cast("string").alias("local")).where("path is not null")
    found = typed.type_names(c.select(java, "file", "name"), types, imports, c.select(java, "file", text("n", nation).alias("package")))
    return found.drop("language")


@_query("""WITH s AS (SELECT s_nationkey AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS k FROM supplier),
f AS (SELECT s.n, s.k, concat('n', s.n, '.C', s.k) AS me, CASE WHEN s.k = 0 OR o.n IS NULL THEN s.n ELSE o.n END AS made FROM s LEFT JOIN (SELECT DISTINCT n FROM s) o ON o.n = (s.n + 1) % 25)
SELECT 'inherits' AS relation_type, me AS source, concat('n', CASE WHEN k = 1 THEN made ELSE n END, '.C', k - 1) AS target, 'resolved' AS resolution_status, CAST(1.0 AS DOUBLE) AS confidence FROM f WHERE k > 0
UNION ALL SELECT 'calls', concat(me, '.run(1)'), concat('n', CASE WHEN k = 1 THEN made ELSE n END, '.C', k - 1, '.own', k - 1, '(0)'), 'resolved', 1.0 FROM f WHERE k > 0
UNION ALL SELECT 'calls', concat(me, '.run(1)'), concat('n', made, '.C0.make(2)'), 'resolved', 1.0 FROM f
UNION ALL SELECT 'calls', concat(me, '.run(1)'), 'missing', 'external', 0.7 FROM f
UNION ALL SELECT 'uses', concat(me, '.run(1)'), concat('n', made, '.C0'), 'resolved', 1.0 FROM f""")
def source_graph(s: SparkSession, d: str) -> DataFrame:
    """A Java class for each supplier: it extends the one before it in its nation, and uses the first class of the next nation, which it imports."""
    w = Window.partitionBy("n").orderBy("s_suppkey")  # of suppliers of a nation
    classes = table(s, d, "supplier").select(F.col("s_nationkey").alias("n"), "s_suppkey").withColumn("k", F.row_number().over(w) - 1)
    other = classes.select(((F.col("n") + 24) % 25).alias("n"), F.col("n").alias("next")).distinct()
    body = F.format_string("public class C%d", "k"), F.when(F.col("k") > 0, F.format_string(" extends C%d", F.col("k") - 1)).otherwise("")
    made = F.format_string(" {\n  public void own%d() { }\n  public static void make(int a, int b) { }\n  public void run(C0 other) { other.make(1, 2); ", "k")
    calls = F.concat(F.when(F.col("k") > 0, F.format_string("own%d(); ", F.col("k") - 1)).otherwise(""), F.lit("missing(3); // not(a, call)\n  }\n}\n"))
    head = F.concat(F.format_string("package n%d;\n", "n"), F.coalesce(F.format_string("import n%d.C0;\n", F.when(F.col("next").isNotNull(), F.col("next"))), F.lit("")))
    files = classes.join(other, "n", "left").select(F.format_string("n%d/C%d.java", "n", "k").alias("path"), F.lit("java").alias("language"), F.encode(F.concat(F.when(F.col("next").isNotNull(), head).otherwise(F.format_string("package n%d;\n", "n")), *body, made, calls), "utf-8").alias("content"))
    # small rows that take long: by number, since partitions joined by their bytes would leave all files to one task
    found = written(records(files.repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "path")))
    rows, _ = analyze.resolved(found)
    names = found.where("record = 'node'").select(F.col("id").alias("_id"), F.col("qualified_name").alias("_name"))
    edges = rules.with_confidence(rows.where("relation_type in ('inherits', 'calls', 'uses')"))
    out = edges.join(names.withColumnsRenamed({"_id": "source_id", "_name": "source"}), "source_id").join(names.withColumnsRenamed({"_id": "target_id", "_name": "_to"}), "target_id", "left")
    return out.select("relation_type", "source", F.coalesce("_to", "label").alias("target"), "resolution_status", "confidence")
