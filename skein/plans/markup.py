"""HTML, CSS and SQL files, and what scripts look up in pages, as nodes, edges and problems of the graph."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import code_text, sql_lineage, web
from skein.operators import resolve
from skein.operators import web as web_joins
from skein.sources.shared import written

#: Languages that analyze() takes here, and the products of SQL among them.
SQL = ("sql", "mysql", "postgresql", "tsql", "oracle")
LANGUAGES = ("html", "css", *SQL)
ROWS = ("source_id", "target_id", "relation_type", "resolution_status", "span", "label", "language")
_SPAN = "struct<start_line:int,start_col:int,end_line:int,end_col:int>"
_NODE = ("id", "kind", "qualified_name", "display_name", "file", "span", "parent_id", "language")


def _nodes(df: DataFrame, **cols: Column) -> DataFrame:
    return df.select(*[cols.get(n, F.lit(None).cast(_SPAN if n == "span" else "string")).alias(n) for n in _NODE])


def _edges(df: DataFrame, source: Column, target: Column, relation: Column, status: Column, label: Column, language: Column, span: Column | None = None) -> DataFrame:
    values = (source, target, relation, status, F.lit(None).cast(_SPAN) if span is None else span, label, language)
    return df.select(*[v.alias(n) for v, n in zip(values, ROWS, strict=True)])


def _module(path: Column, language: Column) -> Column:
    return F.concat(language, F.lit(":"), path, F.lit(":module"))


def _outside(language: Column, kind: str, label: Column) -> Column:
    return F.concat_ws(":", language, F.lit(kind), F.substring(F.sha1(label), 1, 16))


def _point(line: Column, col: Column) -> Column:
    return F.struct(line.alias("start_line"), col.alias("start_col"), line.alias("end_line"), col.alias("end_col")).cast(_SPAN)


def _under(path: Column, reference: Column) -> Column:
    """Paths that a reference of a file may mean: beside it, or from the root; a script's sources may be typed."""
    plain = F.regexp_replace(reference, r"[?#].*$", "")
    folder = F.regexp_extract(path, r"^(.*/)?", 1)
    joined = F.when(plain.startswith("/"), F.substring(plain, 2, 10_000)).otherwise(F.concat(folder, F.regexp_replace(plain, r"^(\./)+", "")))
    # x/../ goes, level by level
    for _ in range(8):
        joined = F.regexp_replace(joined, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    stem = F.regexp_replace(joined, r"\.[cm]?jsx?$", "")
    return F.array_distinct(F.array(joined, *[F.concat(stem, F.lit(e)) for e in (".ts", ".tsx", ".js", ".jsx", ".mjs")], *[F.concat(joined, F.lit(f"/index{e}")) for e in (".ts", ".js", ".html")]))


def path_imports(references: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of references (path, language, reference, relation) to the files they name, or to something outside."""
    refs = written(references.withColumn("ref", F.xxhash64("path", "reference", "relation")).dropDuplicates(["ref"]))
    local = ~F.col("reference").rlike(r"^([a-zA-Z][a-zA-Z+.-]*:|//)")
    hit = resolve.first_path(refs.where(local).select("ref", _under(F.col("path"), F.col("reference")).alias("candidates")), files.select("path"))
    target = files.select(F.col("path").alias("_to"), F.col("language").alias("_to_language"))
    both = refs.join(hit.select("ref", F.col("path").alias("_to")), "ref", "left").join(target, "_to", "left")
    known = F.col("_to").isNotNull()
    status = F.when(known, "resolved").when(local & F.col("reference").rlike(r"^[./]"), "unresolved").otherwise("external")
    to = F.when(known, _module(F.col("_to"), F.col("_to_language"))).otherwise(_outside(F.col("language"), "external", F.col("reference")))
    return _edges(both, _module(F.col("path"), F.col("language")), to, F.col("relation"), status, F.col("reference"), F.col("language"))


def lookups(scripts: DataFrame) -> DataFrame:
    """(path, language, selector, relation) of what scripts (path, language, text) look up in a document; a listener hung on it handles it."""
    call = r"""(?:getElementById|getElementsByClassName|getElementsByTagName|querySelectorAll|querySelector)\(\s*['"][^'"\n]+['"]\s*\)(?:\s*\.\s*addEventListener)?"""
    found = scripts.select("path", "language", F.explode(F.regexp_extract_all("text", F.lit(call), 0)).alias("call"))
    name, what = F.regexp_extract("call", r"^(\w+)", 1), F.regexp_extract("call", r"""['"]([^'"]+)['"]""", 1)
    selector = F.when(name == "getElementById", F.concat(F.lit("#"), what)).when(name == "getElementsByClassName", F.concat(F.lit("."), what)).otherwise(what)
    return found.select("path", "language", selector.alias("selector"), F.when(F.col("call").endswith("addEventListener"), "handles").otherwise("references").alias("relation")).distinct()


def _routines(files: DataFrame) -> DataFrame:
    """(path, language, statement, text) of the statements of SQL files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, k, x.number, x.text) for p, k, t in zip(b["path"], b["language"], b["text"], strict=True) for x in sql_lineage.statements(t or "", k)]
            yield pd.DataFrame(rows, columns=["path", "language", "statement", "text"])

    return files.select("path", "language", "text").mapInPandas(run, "path string, language string, statement int, text string")


_ROUTINE = r"(?is)^\s*create\s+(?:or\s+replace\s+)?(?:definer\s*=\s*\S+\s+)?(function|procedure|trigger)\s+(?:if\s+not\s+exists\s+)?([\w.$\"`\[\]]+)"


def sql(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edge rows) of SQL files (path, language, text): statements, tables that they name, routines and triggers."""
    language = F.col("language")
    parts = written(_routines(files))
    statement = F.concat(language, F.lit(":"), "path", F.lit(":statement:"), F.col("statement").cast("string"))
    found = sql_lineage.table_edges(files, "path", "text", "language").join(files.select("path", "language"), "path")
    touched = found.select("path", "language", "statement", "relation", "table")
    routine = parts.withColumns({"what": F.lower(F.regexp_extract("text", _ROUTINE, 1)), "name": F.regexp_replace(F.regexp_extract("text", _ROUTINE, 2), r'["`\[\]]', "")}).where("name <> ''")
    inside = routine.select("path", "language", "statement", F.explode(code_text.routine_tables(code_text.routine_body(F.col("text")))).alias("t"))
    touched = touched.union(inside.select("path", "language", "statement", "t.relation", "t.table"))
    hung = routine.where("what = 'trigger'").withColumn("table", F.regexp_extract("text", r"(?is)\bon\s+([\w.$]+)", 1)).where("`table` <> ''")
    touched = written(touched.union(hung.select("path", "language", "statement", F.lit("triggers"), "table")).distinct())
    table = lambda name: F.concat(language, F.lit(":table:"), F.lower(name))
    defined = touched.where("relation = 'defines'").select(table(F.col("table")).alias("_id"), F.col("path").alias("_in")).groupBy("_id").agg(F.min("_in").alias("_in"))
    rows = written(touched.withColumn("_id", table(F.col("table"))).join(defined, "_id", "left"))
    names = rows.groupBy("_id", "language").agg(F.min("table").alias("table"), F.min("_in").alias("_in"))
    nodes = _nodes(parts, id=statement, kind=F.lit("unknown"), qualified_name=F.concat("path", F.lit(":"), F.col("statement").cast("string")), display_name=F.substring(F.substring_index("text", "\n", 1), 1, 240), file=F.col("path"), parent_id=_module(F.col("path"), language), language=language)
    nodes = nodes.unionByName(_nodes(names, id=F.col("_id"), kind=F.when(F.col("_in").isNotNull(), "type").otherwise("external"), qualified_name=F.col("table"), display_name=F.col("table"), file=F.col("_in"), language=language))
    made = F.concat(statement, F.lit(":"), "what")
    nodes = nodes.unionByName(_nodes(routine, id=made, kind=F.lit("function"), qualified_name=F.col("name"), display_name=F.col("name"), file=F.col("path"), parent_id=statement, language=language))
    edges = _edges(parts, _module(F.col("path"), language), statement, F.lit("contains"), F.lit("resolved"), F.col("statement").cast("string"), language)
    edges = edges.unionByName(_edges(rows, statement, F.col("_id"), F.col("relation"), F.when(F.col("_in").isNotNull(), "resolved").otherwise("external"), F.col("table"), language))
    return nodes, edges.unionByName(_edges(routine, statement, made, F.lit("defines"), F.lit("resolved"), F.col("name"), language))


def markup(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edge rows, problems) of files (path, language, content) in LANGUAGES, and of the lookups of scripts among the others."""
    own = written(files.where(F.col("language").isin(*LANGUAGES)).select("path", "language", "content", F.decode(F.coalesce("content", F.lit(b"")), "utf-8").alias("text")))
    modules = _nodes(own, id=_module(F.col("path"), F.col("language")), kind=F.lit("module"), qualified_name=F.col("path"), display_name=F.substring_index("path", "/", -1), file=F.col("path"), language=F.col("language"))
    elements = written(web.elements(own.where("language = 'html'")))
    element = lambda f, k: F.concat(F.lit("html:"), F.col(f), F.lit(":element:"), F.col(k).cast("string"))
    holder = F.when(F.col("parent").isNull(), _module(F.col("file"), F.lit("html"))).otherwise(element("file", "parent"))
    shown = F.concat(F.col("tag"), F.when(F.coalesce("dom_id", F.lit("")) != "", F.concat(F.lit("#"), "dom_id")).otherwise(""))
    at = _point(F.col("line"), F.col("col"))
    nodes = modules.unionByName(_nodes(elements, id=element("file", "element"), kind=F.lit("element"), qualified_name=F.concat("file", F.lit(":"), shown, F.lit("@"), F.col("element").cast("string")), display_name=shown, file=F.col("file"), span=at, parent_id=holder, language=F.lit("html")))
    edges = _edges(elements, holder, element("file", "element"), F.lit("contains"), F.lit("resolved"), F.col("tag"), F.lit("html"), at)
    css = own.where("language = 'css'")
    rules = written(web.style_rules(css))
    rule = F.concat(F.lit("css:"), "file", F.lit(":rule:"), F.col("start").cast("string"))
    sheet = _module(F.col("file"), F.lit("css"))
    nodes = nodes.unionByName(_nodes(rules, id=rule, kind=F.lit("style_rule"), qualified_name=F.concat("file", F.lit(":"), "selector"), display_name=F.col("selector"), file=F.col("file"), parent_id=sheet, language=F.lit("css")))
    edges = edges.unionByName(_edges(rules, sheet, rule, F.lit("contains"), F.lit("resolved"), F.col("selector"), F.lit("css")))
    styled = written(web_joins.styles(rules, elements))
    hit = styled.where("status = 'resolved'")
    edges = edges.unionByName(_edges(hit, rule, element("element_file", "element"), F.lit("styles"), F.lit("resolved"), F.col("selector"), F.lit("css")))
    problems = styled.where("status = 'unsupported'").select(F.lit("unsupported_construct").alias("code"), F.lit("info").alias("severity"), F.concat(F.lit("Selector not followed: "), "selector").alias("message"), F.lit(None).cast(_SPAN).alias("span"), rule.alias("node_id"))
    linked = elements.where("reference is not null and reference <> ''").select(F.col("file").alias("path"), F.lit("html").alias("language"), "reference", F.lit("imports").alias("relation"))
    imported = css.select("path", "language", F.explode(F.regexp_extract_all("text", F.lit(r"""@import\s+(?:url\()?\s*['"]?([^'"()\s;]+)"""), 1)).alias("reference"), F.lit("imports").alias("relation"))
    edges = edges.unionByName(path_imports(linked.union(imported), files))
    scripts = files.where("language in ('javascript', 'typescript')").select("path", "language", F.decode(F.coalesce("content", F.lit(b"")), "utf-8").alias("text"))
    asked = written(lookups(scripts).withColumn("ref", F.xxhash64("path", "selector", "relation")))
    found = web_joins.matches(asked, elements)
    resolved_ = F.col("status") == "resolved"
    to = F.when(resolved_, element("element_file", "element")).otherwise(_outside(F.col("language"), "unknown", F.col("selector")))
    edges = edges.unionByName(_edges(found, _module(F.col("path"), F.col("language")), to, F.col("relation"), F.col("status"), F.col("selector"), F.col("language")))
    problems = problems.unionByName(found.where(~resolved_).select(F.lit("unresolved_dom_reference").alias("code"), F.lit("warning").alias("severity"), F.concat(F.lit("Not found in any page: "), "selector").alias("message"), F.lit(None).cast(_SPAN).alias("span"), _module(F.col("path"), F.col("language")).alias("node_id")))
    sql_nodes, sql_edges = sql(own.where(F.col("language").isin(*SQL)))
    return nodes.unionByName(sql_nodes), edges.unionByName(sql_edges), problems
