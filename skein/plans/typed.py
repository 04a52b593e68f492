"""Calls, inheritance and uses of languages other than Python, across files: types by packages and imports, members by owner and number of arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import infer, resolve
from skein.sources.shared import written

#: Languages in which a name that nothing defines is taken to come from outside; in the others it stays unresolved.
OUTSIDE = ("java", "csharp", "go", "rust", "kotlin", "php", "ruby", "swift", "c", "cpp", "cuda")
#: Languages whose calls on a receiver are never resolved, and those where a receiver of unknown type leaves the call to any method of the name.
BLIND, LOOSE = ("c", "cpp", "cuda"), ("javascript", "typescript", "kotlin", "dart", "scala", "ruby")
_TYPES = ("class", "interface", "type", "namespace")
_CALLABLE = ("function", "method", "lambda")
_LAST = r"([^.:\\/]+)$"


def _before(qualified: Column) -> Column:
    """What a qualified name is in."""
    return F.regexp_replace(qualified, r"(?:\.|::|\\)?[^.:\\/]+$", "")


def type_names(asked: DataFrame, types: DataFrame, imports: DataFrame, packages: DataFrame) -> DataFrame:
    """asked (language, file, name) with target_id, status and how: types in the order in which a file sees them.

    First those of the file, then what it imports by name or alias, then its own package, then packages that it
    imports whole, and last any type of that name in the language; the first of these that has a type decides.
    types: (language, file, package, name, qualified, target); imports: (language, file, path, local: the name it
    goes by or null); packages: (language, file, package).
    """
    named = imports.withColumn("name", F.coalesce("local", F.regexp_extract("path", _LAST, 1))).where("name not in ('', '*')").select("language", "file", "name", "path")
    whole = imports.withColumn("package", F.regexp_replace("path", r"(?:\.|::|\\)\*$", "")).select("language", "file", "package").distinct()
    place = ["language", "file", "name"]
    asked_once = asked.select(*place).distinct()
    by_import = types.withColumnRenamed("qualified", "path")
    steps = [
        (asked_once, types, place, "file"), (asked_once.join(named, place), by_import, ["language", "path"], "import"), (asked_once.join(packages, ["language", "file"]), types, ["language", "package", "name"], "package"),
        (asked_once.join(whole, ["language", "file"]), types, ["language", "package", "name"], "whole import"), (asked_once, types, ["language", "name"], "name"),
    ]
    found = None
    for k, (rows, of, keys, how) in enumerate(steps):
        part = resolve.counted_targets(rows, of, place, keys, "target").select(*place, F.lit(k).alias("_step"), F.struct(F.col("_n").alias("n"), F.col("_t").alias("target"), F.lit(how).alias("how")).alias("b"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy(*place).agg(F.min_by("b", "_step").alias("b"))
    out = asked.join(best, place, "left")
    n = F.coalesce("b.n", F.lit(0))
    status = F.when(n == 1, "resolved").when(n > 1, "unresolved").otherwise("external")
    return out.select("language", "file", "name", n.alias("candidates"), F.when(n == 1, F.col("b.target")).alias("target_id"), status.alias("status"), "b.how")


def typed(found: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, target_id, status) of refs: (ref, file, language, scope, relation, name, arity, owner, receiver), all of one name.

    Types are found as their file sees them (type_names). A call on this or without a receiver goes to the owner's
    members of that name and number of arguments, nearest first along what it inherits, and else to the only
    definition of them in the language; a call on a variable or a type goes to the members of its type; a call of a
    type's name makes one.
    """
    mine = found.where("language <> 'python'")
    nodes = written(mine.where("record = 'node'").select("id", "language", "file", "kind", "name", "qualified_name", "arity", "owner", "start"))
    types = written(nodes.where(F.col("kind").isin(*_TYPES)).select("language", "file", _before(F.col("qualified_name")).alias("package"), "name", F.col("qualified_name").alias("qualified"), F.col("id").alias("target")))
    packages = nodes.where("kind = 'namespace'").groupBy("language", "file").agg(F.min_by("qualified_name", "start").alias("package"))
    imports = mine.where("record = 'import' and module_name is not null").select("language", "file", F.col("module_name").alias("path"), F.col("receiver").alias("local"))
    variables = written(mine.where("record = 'variable'").select("language", "file", "scope", "name", "owner", F.col("target").alias("type")))
    refs = written(refs)
    ask = lambda df, name: df.where(F.col(name).isNotNull()).select("language", "file", F.col(name).alias("name"))
    asked = ask(refs, "name").union(ask(refs, "owner")).union(ask(refs, "receiver")).union(ask(nodes, "owner")).union(ask(variables, "owner")).union(ask(variables, "type")).distinct()
    known = written(type_names(asked, types, imports, packages))

    def of(df: DataFrame, name: str, out: str, status: str | None = None) -> DataFrame:
        cols = [F.col("target_id").alias(out), *([F.col("status").alias(status), F.col("candidates").alias(f"{status}_n")] if status else [])]
        return df.join(known.select("language", "file", F.col("name").alias(name), *cols), ["language", "file", name], "left")

    by_type = written(of(of(refs.where("relation in ('inherits', 'uses')"), "name", "target_id", "status"), "owner", "child"))
    parents = written(by_type.where("relation = 'inherits' and target_id is not null and child is not null").select("child", F.col("target_id").alias("parent")).distinct())
    calls = written(of(of(refs.where("relation = 'calls'"), "owner", "caller_owner"), "name", "_made", "_made_status").drop("owner"))
    held = written(of(of(variables, "owner", "at"), "type", "type_id").where("type_id is not null"))
    scoped = held.select("scope", "name", F.col("type_id").alias("type")).union(held.where("at is not null").select("at", "name", "type_id"))
    asked = of(calls.where("receiver is not null"), "receiver", "_static")
    own = F.col("receiver").isin("this", "self", "Self")
    asked = asked.select("ref", F.col("scope").alias("caller"), "caller_owner", F.when(own, F.lit("this")).otherwise(F.col("receiver")).alias("receiver"), "_static")
    nobody = held.select("name").limit(0)  # types are told by their ids, below
    told = infer.receiver_types(asked, scoped, nobody).select("ref", F.coalesce("owner", "_static").alias("at"))
    calls = written(calls.join(told, "ref", "left").withColumn("at", F.when(F.col("receiver").isNull(), F.col("caller_owner")).otherwise(F.col("at"))))
    callable_ = nodes.where(F.col("kind").isin(*_CALLABLE))
    members = written(of(callable_.where("owner is not null"), "owner", "_of").where("_of is not null").select(F.col("_of").alias("owner"), "name", "arity", F.col("id").alias("target")))
    by_owner = infer.member_calls(calls.select("ref", F.col("at").alias("owner"), "name", "arity"), parents, members).select("ref", F.col("target_id").alias("_member"), F.col("candidates").alias("_members"))
    every = callable_.select("language", "name", F.coalesce("arity", F.lit(0)).alias("arity"), F.col("id").alias("target"))
    anywhere = resolve.unique_match(calls.select("ref", "language", "name", F.coalesce("arity", F.lit(0)).alias("arity")), every, ["language", "name", "arity"]).select("ref", F.col("target_id").alias("_any"), F.col("candidates").alias("_anys"))
    rows = calls.join(by_owner, "ref", "left").join(anywhere, "ref", "left")
    bare, loose = F.col("receiver").isNull(), F.col("language").isin(*LOOSE) & F.col("at").isNull()
    target = F.when(F.col("language").isin(*BLIND) & ~bare, F.lit(None).cast("string")).otherwise(
        F.coalesce("_member", F.when((bare | loose) & (F.coalesce("_members", F.lit(0)) == 0), F.coalesce("_any", "_made")))
    )
    several = (F.coalesce("_members", F.lit(0)) > 1) | (bare & ((F.col("_anys") > 1) | (F.col("_made_status_n") > 1)))
    unknown = ~bare & F.col("at").isNull() & ~F.col("language").isin("php", "ruby", "swift")
    outside = F.col("language").isin(*OUTSIDE) & ~several & ~unknown & ~(F.col("language").isin(*BLIND) & ~bare)
    status = F.when(target.isNotNull(), "resolved").when(outside, "external").otherwise("unresolved")
    told_types = by_type.select("ref", "target_id", F.when(F.col("status") != "external", F.col("status")).when(F.col("language").isin(*OUTSIDE), "external").otherwise("unresolved").alias("status"))
    return rows.select("ref", target.alias("target_id"), status.alias("status")).unionByName(told_types)
