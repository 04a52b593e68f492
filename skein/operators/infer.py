"""Rules that find what a call means from what is known of its receiver, its callee's result, or its name alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import resolve
from skein.sources.shared import written

#: Languages whose names don't tell case apart.
FOLDED = ("vbnet", "vba", "fortran", "pascal", "cobol")


def receiver_types(calls: DataFrame, variables: DataFrame, types: DataFrame) -> DataFrame:
    """calls with `owner`, the type of the receiver: a variable of the caller, one of the caller's owner, or a type of that name.

    calls: (ref, caller, caller_owner, receiver); variables: (scope, name, type); types: (name). A variable of
    several types tells nothing; an empty receiver and this or self is the caller's own owner.
    """
    known = variables.groupBy("scope", "name").agg(F.count_distinct("type").alias("_n"), F.min("type").alias("type")).where("_n = 1").drop("_n")
    of = lambda scope, out: known.select(F.col("scope").alias(scope), F.col("name").alias("receiver"), F.col("type").alias(out))
    rows = calls.join(of("caller", "_local"), ["caller", "receiver"], "left").join(of("caller_owner", "_field"), ["caller_owner", "receiver"], "left")
    rows = rows.join(types.select(F.col("name").alias("receiver"), F.lit(True).alias("_is_type")).distinct(), "receiver", "left")
    own = F.coalesce("receiver", F.lit("")).isin("", "this", "self")
    owner = F.when(own, F.col("caller_owner")).otherwise(F.coalesce("_local", "_field", F.when(F.col("_is_type"), F.col("receiver"))))
    how = F.when(own, "own").when(F.col("_local").isNotNull(), "variable").when(F.col("_field").isNotNull(), "field").when(F.col("_is_type"), "type").otherwise("unknown")
    return rows.withColumns({"owner": owner, "how": how}).drop("_local", "_field", "_is_type")


def member_calls(calls: DataFrame, parents: DataFrame, members: DataFrame, nearest: bool = True) -> DataFrame:
    """calls (ref, owner, name, arity) with target_id and status, by members (owner, name, arity, target) of the owner and what it inherits.

    One candidate resolves, several don't, none is external; a call whose owner isn't known is unresolved.
    """
    key = lambda df: df.withColumn("name", F.concat_ws("/", "name", F.col("arity").cast("string")))
    asked = written(key(calls).where("owner is not null"))
    found = resolve.owner_members(asked.select("ref", "owner", "name"), parents, key(members).select("owner", "name", "target"), nearest)
    out = calls.join(found, "ref", "left")
    n = F.coalesce("candidates", F.lit(0))
    status = F.when(F.col("owner").isNull(), "unresolved").when(n == 1, "resolved").when(n > 1, "unresolved").otherwise("external")
    return out.withColumns({"candidates": n, "status": status})


def call_results(calls: DataFrame, definitions: DataFrame, types: DataFrame) -> DataFrame:
    """(ref, type_id, evidence) of what calls give back: a class gives its instance, a function what its annotation names, if that is one class.

    calls: (ref, target_id); definitions: (id, kind, returns: the annotation or null, module); types: (module, name, id).
    """
    plain = F.trim(F.regexp_replace("returns", r"""^['"]|['"]$""", ""))
    callee = calls.join(definitions.select(F.col("id").alias("target_id"), "kind", "module", F.when(plain.rlike(r"^[A-Za-z_][\w.]*$"), plain).alias("_returns")), "target_id")
    named = types.groupBy("module", F.col("name").alias("_returns")).agg(F.count_distinct("id").alias("_n"), F.min("id").alias("_type"))
    rows = callee.join(named.where("_n = 1"), ["module", "_returns"], "left")
    type_id = F.when(F.col("kind") == "class", F.col("target_id")).when(F.col("kind").isin("function", "method"), F.col("_type"))
    evidence = F.when(F.col("kind") == "class", "constructor").otherwise("return annotation")
    return rows.select("ref", type_id.alias("type_id"), evidence.alias("evidence")).where("type_id is not null")


def global_names(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """references (ref, language, name) by the one definition (language, name, target) of that name anywhere in the language."""
    key = F.when(F.col("language").isin(*FOLDED), F.lower("name")).otherwise(F.col("name"))
    found = resolve.unique_match(references.withColumn("_key", key), definitions.withColumn("_key", key).select("language", "_key", "target"), ["language", "_key"])
    return found.withColumn("status", F.when(F.col("status") == "resolved", "resolved").otherwise("unresolved")).drop("_key")


def symbol_cascade(references: DataFrame, imports: DataFrame, definitions: DataFrame) -> DataFrame:
    """references (ref, file, name, qualified) with target_id: what the file imports under the name, the only one of the
    qualified name, the file's own last definition, the only one of the name. how tells which.

    imports: (file, name, target); definitions: (target, file, name, qualified, start).
    """
    only = lambda keys, out: definitions.groupBy(*keys).agg(F.count_distinct("target").alias("_n"), F.min("target").alias(out)).where("_n = 1").drop("_n")
    bound = imports.groupBy("file", "name").agg(F.max("target").alias("_import"))
    local = definitions.groupBy("file", "name").agg(F.max_by("target", F.struct("start", "target")).alias("_local"))
    rows = references.join(bound, ["file", "name"], "left").join(only(["qualified"], "_whole"), "qualified", "left").join(local, ["file", "name"], "left").join(only(["name"], "_any"), "name", "left")
    how = F.when(F.col("_import").isNotNull(), "import").when(F.col("_whole").isNotNull(), "qualified").when(F.col("_local").isNotNull(), "file").when(F.col("_any").isNotNull(), "name")
    return rows.withColumns({"target_id": F.coalesce("_import", "_whole", "_local", "_any"), "how": how}).drop("_import", "_whole", "_local", "_any")


def impl_owners(impls: DataFrame, types: DataFrame) -> DataFrame:
    """impls (ref, self_type) with owner: the only type of that name, else the type as it is written."""
    found = resolve.unique_match(impls, types.select(F.col("name").alias("self_type"), "target"), ["self_type"])
    return found.withColumn("owner", F.coalesce("target_id", "self_type")).drop("candidates", "status", "target_id")


def real_paths(paths: DataFrame, aliases: DataFrame) -> DataFrame:
    """paths (ref, module, path) with `real`: crate, self and super replaced, and aliases followed until none is left.

    aliases: (module, local, path). A cycle of aliases ends where it closes. A module is named crate::a::b.
    """
    up = F.when(F.instr("module", "::") > 0, F.regexp_extract("module", r"^(.*)::[^:]+$", 1)).otherwise(F.col("module"))
    first, rest = F.substring_index("path", "::", 1), F.regexp_replace("path", r"^[^:]+", "")
    plain = F.when(first == "self", F.concat("module", rest)).when(first == "super", F.concat(up, rest)).otherwise(F.col("path"))
    known = aliases.select(F.col("module").alias("_m"), F.col("local").alias("_local"), F.col("path").alias("_to"))
    now = written(paths.withColumns({"real": plain, "_seen": F.array("path"), "_open": F.lit(True)}))
    while not now.where("_open").isEmpty():
        asked = now.withColumns({"_first": F.substring_index("real", "::", 1), "_rest": F.regexp_replace("real", r"^[^:]+", "")})
        hit = asked.join(known, (F.col("_m") == F.col("module")) & (F.col("_local") == F.col("_first")) & F.col("_open"), "left")
        to = F.concat("_to", "_rest")
        go = F.col("_to").isNotNull() & ~F.array_contains("_seen", to)
        now = written(hit.withColumns({"_new": F.when(go, to).otherwise(F.col("real"))}).select(*paths.columns, F.col("_new").alias("real"), F.when(go, F.array_append("_seen", to)).otherwise(F.col("_seen")).alias("_seen"), go.alias("_open")))
    return now.drop("_seen", "_open")
