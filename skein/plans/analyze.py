"""From a source tree to a graph: scan, extract once, resolve by joins."""

from __future__ import annotations

import builtins

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.extract import records
from skein.functions.scalars import visibility
from skein.operators import resolve
from skein.plans import rules
from skein.plans.markup import LANGUAGES, markup
from skein.plans.results import variable_types
from skein.plans.typed import typed
from skein.sources.config import refined_language
from skein.sources.files import EXTENSIONS, ScanConfig, scan, skipped
from skein.sources.graph import Graph, conform
from skein.sources.schema import DIAGNOSTICS, EDGES, NODES
from skein.sources.shared import written

#: Languages that share suffixes, told apart by content.
SHARED = ("c", "cpp", "objectivec", "matlab")
#: Names that Python itself binds.
BUILTINS = tuple(n for n in dir(builtins) if not n.startswith("_") or n == "__import__")


def _span():  # noqa: ANN202
    return F.when(F.col("start_line").isNotNull(), F.struct("start_line", "start_col", "end_line", "end_col"))


def _edge(rows: DataFrame) -> DataFrame:
    """Rows of (source_id, target_id, relation_type, resolution_status, span, label) as edges, each once."""
    identity = F.to_json(F.struct("source_id", "target_id", "relation_type", "span", "label"))
    out = rules.with_confidence(rows).withColumns({"id": F.concat(F.lit("edge:"), F.substring(F.sha1(identity), 1, 20)), "provenance": F.lit("ast"), "source_span": F.col("span"), "detail": F.to_json(F.struct(F.col("label").alias("name")))})
    return conform(out, EDGES).dropDuplicates(["id"])


def _outside(rows: DataFrame) -> DataFrame:
    """Nodes for ends that no file defines: external or unknown, named by their label."""
    kind = F.when(F.col("resolution_status") == "external", "external").otherwise("unknown")
    made = rows.where("resolution_status <> 'resolved'").select(F.col("target_id").alias("id"), kind.alias("kind"), F.coalesce(F.nullif("label", F.lit("")), F.lit("<unknown>")).alias("qualified_name"), "language").dropDuplicates(["id"])
    return conform(made.withColumns({"display_name": F.col("qualified_name"), "visibility": F.lit("unknown")}), NODES)


def _placeholder(kind: str, label) :  # noqa: ANN001, ANN202
    return F.concat_ws(":", "language", F.lit(kind), F.substring(F.sha1(F.coalesce(label, F.lit(""))), 1, 16))


def _followed(step: DataFrame, inside: DataFrame) -> DataFrame:
    """step with `at` moved along `rest`, however long: one join a round, until no row has a place and parts left.

    inside: (at, _part, _next). A part that its place doesn't have leaves no place.
    """
    more = F.col("at").isNotNull() & (F.size("rest") > 0)
    step = written(step)
    while not step.where(more).isEmpty():
        moved = step.where(more).withColumn("_part", F.get("rest", F.lit(0))).join(inside, ["at", "_part"], "left")
        moved = moved.withColumns({"at": F.col("_next"), "rest": F.slice("rest", F.lit(2), F.size("rest") - 1)})
        step = written(step.where(~more).unionByName(moved.select(step.columns)))
    return step


def _command_rows(found: DataFrame, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """Rows of what scripts run: calls of functions of the same file, uses of commands from outside, and handles from each step of a pipeline to the next."""
    steps = found.where("record = 'command'").join(modules, "file").join(symbols.select(F.col("scope").alias("module_id"), "name", F.col("target").alias("_f")), ["module_id", "name"], "left")
    known = F.col("_f").isNotNull()
    to = F.when(known, F.col("_f")).otherwise(_placeholder("external", F.col("name")))
    steps = written(steps.withColumns({"to": to, "known": known}))
    status = F.when(F.col("known"), "resolved").otherwise("external")
    runs = steps.select(F.col("scope").alias("source_id"), F.col("to").alias("target_id"), F.when(F.col("known"), "calls").otherwise("uses").alias("relation_type"), status.alias("resolution_status"), _span().alias("span"), F.col("name").alias("label"), "language")
    piped = steps.where("arity is not null").withColumn("at", F.struct("file", "arity", "language"))
    pairs = resolve.adjacent_pairs(piped.withColumn("step", F.struct("to", "known", "name", _span().alias("span"))), "at", "start", "step")
    both = F.when(F.col("before.known") & F.col("after.known"), "resolved").otherwise("external")
    return runs.unionByName(pairs.select(F.col("before.to").alias("source_id"), F.col("after.to").alias("target_id"), F.lit("handles").alias("relation_type"), both.alias("resolution_status"), F.col("after.span").alias("span"), F.col("after.name").alias("label"), F.col("at.language").alias("language")))


def resolved(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges' rows, problems) of extraction records: imports by module, references through scopes and members."""
    nodes = found.where("record = 'node'")
    module = nodes.where("kind = 'module'").select(F.col("qualified_name").alias("module_name"), F.col("id").alias("module_id"))
    symbols = found.where("record = 'binding' and target is not null").groupBy("scope", "name").agg(F.max_by("target", F.struct(F.coalesce("start_line", "start", F.lit(0)), "target")).alias("target"))
    shadows = found.where("record = 'binding' and target is null").select("scope", "name").distinct().join(symbols.select("scope", "name"), ["scope", "name"], "left_anti")
    imports = found.where("record = 'import'").withColumn("ref", F.xxhash64("file", "scope", F.coalesce("name", F.lit("")), F.coalesce("module_name", F.lit("")), F.coalesce("member", F.lit("")), "relation", "start_line", "start_col")).dropDuplicates(["ref"])
    named = imports.where("module_name is not null")
    modules = module.withColumnRenamed("module_id", "id")
    members = symbols.select(F.col("scope").alias("module_id"), "name", F.col("target").alias("id"))
    bound = named.join(resolve.bind_imports(named.select("ref", "module_name", "member"), modules, members), "ref")
    import_rows = bound.select(
        F.col("scope").alias("source_id"), F.when(F.col("status") == "resolved", F.col("target_id")).otherwise(_placeholder("external", F.col("target_id"))).alias("target_id"), F.col("relation").alias("relation_type"),
        F.col("status").alias("resolution_status"), _span().alias("span"), F.col("message").alias("label"), "language",
    )
    open_imports = imports.where("module_name is null").select("scope", _placeholder("unknown", F.col("message")).alias("t"), "relation", F.lit("unsupported"), _span(), "message", "language")
    bindings = symbols.select("scope", "name", "target", F.lit(False).alias("is_import")).union(shadows.select("scope", "name", F.lit(None).cast("string"), F.lit(False))).union(
        bound.where("name is not null").select("scope", "name", F.when(F.col("status") == "resolved", F.col("target_id")).otherwise(_placeholder("external", F.col("target_id"))), F.lit(True))
    )
    refs = written(found.where("record = 'ref'").withColumn("ref", F.xxhash64("file", "scope", "relation", "message", "start_line", "start_col")).dropDuplicates(["ref"]))
    told = written(found.where("language = 'python' and record in ('variable', 'returns')").withColumn("ref", F.xxhash64("file", "record", "scope", F.coalesce("name", "target"), "message", "start_line", "start_col")).dropDuplicates(["ref"]).select("ref", "record", "relation", "scope", "name", "target", "chain", "message"))
    asked = refs.where("chain is not null").select("ref", "scope", "chain").unionByName(told.select("ref", "scope", "chain"))
    heads = asked.select("ref", "scope", F.element_at("chain", 1).alias("name"))
    head = written(resolve.lexical(heads, nodes.select("id", "parent_id"), bindings).select("ref", F.col("target_id").alias("at"), "status", "bound_in", F.col("name").alias("head")))
    inside = written(symbols.select(F.col("scope").alias("at"), F.col("name").alias("_part"), F.col("target").alias("_next")))
    python = nodes.where("language = 'python'")
    unknown = found.where("language = 'python' and record = 'binding' and target is null").select("scope", "name")
    types = variable_types(told, head.select("ref", "at", "bound_in", "head"), python, unknown, lambda step: _followed(step, inside))
    held = types.select(F.col("scope").alias("bound_in"), F.col("name").alias("head"), "type_id")
    head = head.join(held, ["bound_in", "head"], "left").select("ref", F.coalesce("at", F.when(F.col("status") == "unresolved", F.col("type_id"))).alias("at"), "status")
    own = F.col("chain").isNotNull() & F.element_at(F.coalesce("chain", F.array(F.lit(""))), 1).isin("self", "cls") & F.col("in_class").isNotNull()
    step = refs.join(head, "ref", "left").withColumn("at", F.when(own & F.col("at").isNull(), F.col("in_class")).otherwise(F.col("at")))
    step = step.withColumn("rest", F.when(F.size("chain") > 1, F.slice("chain", F.lit(2), F.size("chain") - 1)).otherwise(F.array().cast("array<string>")))
    step = _followed(step, inside)
    # of other languages a definition of the same file goes first only if the call has no receiver
    other = refs.where("language <> 'python'").select("ref", "file", "language", "scope", "relation", F.element_at("chain", 1).alias("name"), "arity", "owner", "receiver")
    found_so = typed(found, other).select("ref", F.col("target_id").alias("_target"), F.col("status").alias("_status"))
    step = step.join(found_so, "ref", "left")
    foreign = F.col("_status").isNotNull()
    step = step.withColumn("at", F.when(~foreign, F.col("at")).when(F.col("_status") == "resolved", F.col("_target")).when(F.col("_status") == "external", _placeholder("external", F.col("message"))))
    known = F.col("at").isNotNull() & (F.size("rest") == 0)
    outside = F.col("at").contains(":external:")
    # a name that nothing binds may be one of the language's own
    builtin = (F.col("language") == "python") & F.col("at").isNull() & (F.col("status") == "unbound") & (F.size("chain") == 1) & F.col("message").isin(*BUILTINS)
    step = step.withColumns({"at": F.when(builtin, _placeholder("external", F.concat(F.lit("builtin:"), "message"))).otherwise(F.col("at")), "message": F.when(builtin, F.concat(F.lit("builtin:"), "message")).otherwise(F.col("message"))})
    status = F.when(known & ~outside, "resolved").when(known, "external").otherwise("unresolved")
    ref_rows = step.select(
        F.col("scope").alias("source_id"), F.when(known, F.col("at")).otherwise(_placeholder("unknown", F.col("message"))).alias("target_id"), F.col("relation").alias("relation_type"),
        status.alias("resolution_status"), _span().alias("span"), F.col("message").alias("label"), "language",
    )
    contains = nodes.where("parent_id is not null").select(F.col("parent_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("contains").alias("relation_type"), F.lit("resolved").alias("resolution_status"), _span().alias("span"), F.col("name").alias("label"), "language")
    files = nodes.where("kind = 'module'").select("file", F.col("id").alias("module_id"))
    rows = written(import_rows.union(open_imports).union(ref_rows).union(contains).unionByName(_command_rows(found, symbols, files)))
    code = F.when(F.col("relation_type").contains("import"), "unresolved_import").when(F.col("relation_type") == "inherits", "unresolved_inheritance").when(F.col("relation_type") == "uses", "unresolved_type").otherwise("unresolved_call")
    problems = rows.where("resolution_status in ('unresolved', 'unsupported')").select(code.alias("code"), F.lit("warning").alias("severity"), F.concat(F.lit("Not resolved: "), "label").alias("message"), "span", F.col("source_id").alias("node_id"))
    return rows, problems


def analyze(spark: SparkSession, root: str, languages: list[str] | None = None, config: ScanConfig | None = None) -> Graph:
    """The graph of a source tree. Files are parsed once, in parallel; what they refer to is found by joins."""
    wanted = languages and [*languages, *(x for x in SHARED if set(languages) & set(SHARED))]
    files = scan(spark, root, wanted, config)
    files = files.withColumn("language", refined_language(F.col("path"), F.col("language"), F.col("content"), languages or list(EXTENSIONS)))
    files = files.where(F.col("language").isin(languages) | F.col("reason").eqNullSafe("symlink")) if languages else files
    kept = written(files.where("reason is null"))
    found = written(records(kept.where(~F.col("language").isin(*LANGUAGES))))
    rows, problems = resolved(found)
    marked, links, more = markup(written(kept.where(F.col("language").isin(*LANGUAGES, "javascript", "typescript")).select("path", "language", "content")))
    rows, problems = written(rows.unionByName(links)), problems.unionByName(more)
    seen = visibility(F.col("name"), F.col("language"), F.col("message"))
    nodes = found.where("record = 'node'").withColumns({"display_name": F.col("name"), "span": _span(), "visibility": seen})
    made = conform(nodes, NODES).unionByName(conform(marked.withColumn("visibility", F.lit("unknown")), NODES))
    failed = found.where("record = 'problem'").select(F.col("name").alias("code"), F.lit("error").alias("severity"), F.coalesce("message", F.lit("?")).alias("message"), "file")
    diagnostics = conform(failed, DIAGNOSTICS).unionByName(conform(problems, DIAGNOSTICS)).unionByName(conform(skipped(files), DIAGNOSTICS))
    outside = _outside(rows).join(made.select("id"), "id", "left_anti")
    return Graph(made.unionByName(outside), _edge(rows), diagnostics, {"languages": languages})
