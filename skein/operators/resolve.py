"""Resolution of references to definitions, as joins.

Every rule gives each reference one target or none, and says how: resolved (one definition), unresolved
(several, or a shadowing binding of unknown value) or external (none).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.rollup import ancestors
from skein.sources.shared import written


def unique_match(references: DataFrame, definitions: DataFrame, keys: list[str], ref: str = "ref", target: str = "target") -> DataFrame:
    """references with candidates (distinct definitions on the keys), target_id and status."""
    counted = definitions.groupBy(*keys).agg(F.count_distinct(target).alias("candidates"), F.min(target).alias("_only"))
    out = references.join(counted, keys, "left")
    n = F.coalesce("candidates", F.lit(0))
    status = F.when(n == 1, "resolved").when(n > 1, "unresolved").otherwise("external")
    return out.withColumns({"candidates": n, "target_id": F.when(n == 1, F.col("_only")), "status": status}).drop("_only")


def counted_targets(asked: DataFrame, definitions: DataFrame, by: list[str], keys: list[str], target: str) -> DataFrame:
    """(by, _n, _t): how many distinct targets all keys of a `by` have together, and the least; no row for one without a definition.

    asked: (by, keys); definitions: (keys, target). Targets are counted once for each key, so the rows are as many as
    the asked ones, however many definitions a key has. Counts of several keys add up but for targets that more than
    one key has; those are told apart once for each set of keys that is asked.
    """
    if set(keys) <= set(by):  # one key each
        per_key = definitions.groupBy(*keys).agg(F.count_distinct(target).alias("_n"), F.min(target).alias("_t"))
        return asked.select(*by).distinct().join(per_key, keys).select(*by, "_n", "_t")
    rows = definitions.select(*keys, target).distinct()
    several = rows.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("_keys")).where("_keys > 1").select(target, F.lit(True).alias("_several"))
    marked = rows.join(several, target, "left")
    per_key = marked.groupBy(*keys).agg(F.count(target).alias("_all"), F.count("_several").alias("_shared"), F.min(target).alias("_least"))
    hit = asked.select(*dict.fromkeys([*by, *keys])).distinct().join(per_key, keys)
    of = hit.groupBy(*by).agg(F.sum("_all").alias("_all"), F.sum("_shared").alias("_shared"), F.min("_least").alias("_t"), F.array_sort(F.collect_set(F.struct(*keys))).alias("_set"))
    overlap = (F.size("_set") > 1) & (F.col("_shared") > 0)
    of = of.withColumn("_set", F.when(overlap, F.col("_set")))
    sets = of.where("_set is not null").select("_set").distinct().withColumn("_key", F.explode("_set")).select("_set", "_key.*")
    once = sets.join(marked.where("_several").select(*keys, target), keys).groupBy("_set").agg(F.count_distinct(target).alias("_once"))
    n = F.when(F.col("_set").isNull(), F.col("_all")).otherwise(F.col("_all") - F.col("_shared") + F.col("_once"))
    return of.join(once, "_set", "left").select(*by, n.alias("_n"), "_t")


def cascade(references: DataFrame, definitions: DataFrame, ref: str = "ref", names: str = "names", name: str = "name", target: str = "target", short: Column | None = None) -> DataFrame:
    """References with several possible names: definitions of all names together; only if there is none, those of the short name.

    references: (ref, names: array). definitions: (name, target). short: the last part of a name.
    """
    short = F.substring_index(F.col(name), ".", -1) if short is None else short
    asked = references.select(ref, F.explode(names).alias(name))
    full = counted_targets(asked, definitions, [ref], [name], target)
    rest = asked.join(full.select(ref), ref, "left_anti").select(ref, short.alias("_short")).distinct()
    by_short = definitions.select(short.alias("_short"), target)
    fallback = counted_targets(rest, by_short, [ref], ["_short"], target)
    found = full.withColumn("how", F.lit("name")).unionByName(fallback.withColumn("how", F.lit("short name")))
    out = references.select(ref).join(found, ref, "left")
    n = F.coalesce("_n", F.lit(0))
    return out.select(ref, n.alias("candidates"), F.when(n == 1, F.col("_t")).alias("target_id"), F.when(n == 1, "resolved").when(n > 1, "unresolved").otherwise("external").alias("status"), "how")


def lexical(references: DataFrame, scopes: DataFrame, bindings: DataFrame) -> DataFrame:
    """The nearest enclosing scope that binds a name decides, even if it binds it to nothing known.

    references: (ref, scope, name); scopes: (id, parent_id); bindings: (scope, name, target, is_import),
    target null for a binding of unknown value. A symbol goes before an import of the same scope.
    """
    chain = ancestors(scopes).select(F.col("id").alias("scope"), F.col("ancestor").alias("at"), "depth")
    bound = bindings.select(F.col("scope").alias("at"), "name", "target", "is_import")
    hit = references.join(chain, "scope").join(bound, ["at", "name"])
    best = hit.groupBy("ref").agg(F.min_by(F.struct("target", "at"), F.struct("depth", "is_import")).alias("b"))
    out = references.join(best, "ref", "left")
    status = F.when(F.col("b").isNull(), "unbound").when(F.col("b.target").isNull(), "unresolved").otherwise("resolved")
    return out.select("ref", "scope", "name", F.col("b.at").alias("bound_in"), F.col("b.target").alias("target_id"), status.alias("status"))


def bind_imports(imports: DataFrame, modules: DataFrame, symbols: DataFrame) -> DataFrame:
    """imports: (ref, module_name, member or null); modules: (module_name, id); symbols: (module_id, name, id).

    Without member: the module, else the module of the first part, else external. With one: a symbol of
    the module, else its submodule of that name, else external.
    """
    by_name = lambda c, out: modules.select(F.col("module_name").alias(c), F.col("id").alias(out))
    rows = imports.withColumns({"_first": F.substring_index("module_name", ".", 1), "_sub": F.concat_ws(".", "module_name", "member")})
    rows = rows.join(by_name("module_name", "_module"), "module_name", "left").join(by_name("_first", "_top"), "_first", "left").join(by_name("_sub", "_submodule"), "_sub", "left")
    names = symbols.select(F.col("module_id").alias("_module"), F.col("name").alias("member"), F.col("id").alias("_symbol"))
    rows = rows.join(names, ["_module", "member"], "left")
    inside = F.when(F.col("_module").isNotNull(), F.coalesce("_symbol", "_submodule"))
    target = F.when(F.col("member").isNull(), F.coalesce("_module", "_top")).otherwise(inside)
    label = F.when(F.col("member").isNull(), F.concat(F.lit("module:"), "module_name")).otherwise(F.concat(F.lit("symbol:"), "module_name", F.lit("."), "member"))
    return rows.select("ref", F.coalesce(target, label).alias("target_id"), F.when(target.isNotNull(), "resolved").otherwise("external").alias("status"))


def first_definition(references: DataFrame, definitions: DataFrame, order: list[str], name: str = "name", target: str = "target") -> DataFrame:
    """Names without regard to case; the first definition in the order wins, however many there are."""
    first = definitions.groupBy(F.lower(name).alias("_name")).agg(F.min_by(target, F.struct(*order)).alias("target_id"))
    return references.withColumn("_name", F.lower(name)).join(first, "_name", "left").drop("_name")


def first_path(references: DataFrame, files: DataFrame, ref: str = "ref", candidates: str = "candidates") -> DataFrame:
    """The first of a reference's candidate paths that is a file. Paths that climb out of the root never match."""
    tried = references.select(ref, F.posexplode(candidates).alias("pos", "path")).where(~F.col("path").rlike(r"(^|/)\.\.(/|$)|^/"))
    hit = tried.join(files.select("path"), "path").groupBy(ref).agg(F.min_by("path", "pos").alias("path"))
    return references.select(ref).join(hit, ref, "left")


def enclosing(points: DataFrame, scopes: DataFrame, by: str, point: str = "at", start: str = "start", end: str = "end", width: int = 4096) -> DataFrame:
    """points with scope_id, the scope of the same `by` that holds the point and starts last.

    scopes: (by, start, end or null, scope_id). Positions are cut into cells of `width`, and a scope is listed
    in all cells with points that it reaches, so a point meets the scopes of its cell, not those of its whole
    `by`: the join is one of equality, with few rows for a key where scopes are short or nest.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    spans = scopes.select(by, F.col(start).alias("_s"), F.col(end).alias("_e"), "scope_id")
    used = points.select(by, cell(point).alias("_cell")).distinct()
    most = used.groupBy(by).agg(F.max("_cell").alias("_most"))
    # only cells that hold points are listed, and for each of them the scopes that reach it
    reach = spans.join(most, by).withColumns({"_a": cell("_s"), "_b": F.least(F.coalesce(F.floor((F.col("_e") - 1) / width), F.col("_most")), F.col("_most"))}).where("_a <= _b")
    listed = reach.withColumn("_cell", F.explode(F.sequence("_a", "_b"))).join(used, [by, "_cell"], "left_semi")
    hit = points.withColumn("_cell", cell(point)).join(listed.select(by, "_cell", "_s", "_e", "scope_id"), [by, "_cell"])
    hit = hit.where((F.col("_s") <= F.col(point)) & (F.col("_e").isNull() | (F.col("_e") > F.col(point))))
    best = hit.groupBy(by, "ref").agg(F.max_by("scope_id", F.struct("_s", "scope_id")).alias("scope_id"))
    return points.join(best, [by, "ref"], "left")


def last_started(points: DataFrame, scopes: DataFrame, by: str, point: str = "at", start: str = "start") -> DataFrame:
    """points with scope_id, the scope of `by` started last at or before the point: an as-of join without a join."""
    rows = scopes.select(by, F.col(start).alias("_at"), F.lit(0).alias("_kind"), "scope_id", F.lit(None).cast(points.schema["ref"].dataType).alias("ref")).unionByName(
        points.select(by, F.col(point).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(scopes.schema["scope_id"].dataType).alias("scope_id"), "ref")
    )
    w = Window.partitionBy(by).orderBy("_at", "_kind", "scope_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("scope_id", F.last("scope_id", ignorenulls=True).over(w)).where("_kind = 1").select("ref", by, F.col("_at").alias(point), "scope_id")


def owner_members(owners: DataFrame, parents: DataFrame, members: DataFrame, nearest: bool) -> DataFrame:
    """Members found for (ref, owner, name) in an owner and what it inherits: of the nearest owner that has one, or of all."""
    hit = owners.join(holders(owners.select("owner", "name"), parents, members, nearest), ["owner", "name"])
    if nearest:
        least = hit.groupBy("ref").agg(F.min("depth").alias("depth"))
        hit = hit.join(least, ["ref", "depth"])
    found = counted_targets(hit, members.select(F.col("owner").alias("at"), "name", "target"), ["ref"], ["at", "name"], "target")
    out = owners.join(found, "ref", "left").withColumn("candidates", F.coalesce("_n", F.lit(0)))
    return out.select("ref", "candidates", F.when(F.col("candidates") == 1, F.col("_t")).alias("target_id"))


def holders(asked: DataFrame, parents: DataFrame, members: DataFrame, nearest: bool) -> DataFrame:
    """(owner, name, at, depth): what has a member of the name among an owner and all that it inherits, each at its least depth.

    parents: (child, parent); cycles end. A name that no owner has is not looked for, and with `nearest` an owner is
    followed no farther than the first depth that has the name, so chains are walked only as far as the answer lies.
    """
    has = members.select(F.col("owner").alias("at"), "name").distinct().withColumn("_has", F.lit(True))
    up = parents.select(F.col("child").alias("at"), F.col("parent").alias("_up")).where("_up is not null").distinct()
    step = asked.distinct().join(has.select("name").distinct(), "name", "left_semi").select("owner", "name", F.col("owner").alias("at"))
    depth = 0
    told = lambda df: written(df.join(has, ["at", "name"], "left").select("owner", "name", "at", F.lit(depth).alias("depth"), F.coalesce("_has", F.lit(False)).alias("_has")))
    level = told(step)
    parts = [level]
    while not level.isEmpty():
        if len(parts) > 16:  # plans stay small, however long the chains
            parts = [written(reduce(DataFrame.union, parts))]
        seen = reduce(DataFrame.union, parts)
        follow = level.join(level.where("_has").select("owner", "name"), ["owner", "name"], "left_anti") if nearest else level
        step = follow.join(up, "at").select("owner", "name", F.col("_up").alias("at")).distinct().join(seen.select("owner", "name", "at"), ["owner", "name", "at"], "left_anti")
        depth += 1
        level = told(step)
        parts.append(level)
    return reduce(DataFrame.union, parts).where("_has").drop("_has")


def next_start(declarations: DataFrame, by: str, start: str) -> DataFrame:
    """declarations with `next_start`, where the next one of the same `by` starts; null after the last."""
    return declarations.withColumn("next_start", F.lead(start).over(Window.partitionBy(by).orderBy(start)))


def adjacent_pairs(steps: DataFrame, by: str, order: str, what: str) -> DataFrame:
    """(by, before, after) of neighbours in a sequence."""
    return steps.select(by, F.col(what).alias("before"), F.lead(what).over(Window.partitionBy(by).orderBy(order)).alias("after")).where("after is not null")


def distinct_ids(base: DataFrame, key: str, order: list[str]) -> DataFrame:
    """base with `id`: the key, and ~1, ~2 and so on from its second use."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return base.withColumn("_k", k).withColumn("id", F.when(F.col("_k") == 0, F.col(key)).otherwise(F.concat(F.col(key), F.lit("~"), F.col("_k")))).drop("_k")
