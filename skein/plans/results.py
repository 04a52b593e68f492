"""What Python variables hold: annotated types, made objects and results of calls, to a fixed point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import infer
from skein.sources.shared import written

Followed = Callable[[DataFrame], DataFrame]


def variable_types(told: DataFrame, heads: DataFrame, nodes: DataFrame, bindings: DataFrame, followed: Followed) -> DataFrame:
    """(scope, name, type_id) of variables of one known class.

    told: (ref, record, relation, scope, name, target, chain, message), records variable and returns; heads: (ref, at,
    bound_in, head) of their chains; bindings: (scope, name) of names of unknown value, one row for each time they are
    bound; followed moves (at, rest) along rest. A name that is bound twice, or in two ways, has no type.

    Each round takes only the variables whose chain begins with a name that the last round found the type of.
    """
    once = bindings.groupBy("scope", "name").count().where("count = 1").select("scope", "name")
    variables = told.where("record = 'variable'").groupBy("scope", "name").agg(F.count(F.lit(1)).alias("n"), F.min("ref").alias("ref")).where("n = 1").join(once, ["scope", "name"], "left_semi")
    rest = F.slice("chain", F.lit(2), F.size("chain") - 1)
    asked = written(told.join(heads, "ref", "left").withColumn("rest", rest))
    classes = nodes.where("kind = 'class'").select("id")
    known = followed(asked.where("at is not null").select("ref", "at", "rest")).where("at is not null and size(rest) = 0").select("ref", "at")
    known = written(asked.select("ref", "record", "relation", "target", "message").join(known, "ref"))
    returns = known.where("record = 'returns'").join(classes.withColumnRenamed("id", "at"), "at", "left_semi").select(F.col("target").alias("id"), F.col("message").alias("returns"), F.col("at").alias("type_id"))
    returns = written(returns.dropDuplicates(["id"]))
    definitions = written(nodes.select("id", "kind", F.col("id").alias("module")).join(returns.select("id", "returns"), "id", "left"))
    named = returns.select(F.col("id").alias("module"), F.col("returns").alias("name"), F.col("type_id").alias("id"))
    spots = written(variables.select("scope", "name", "ref").join(asked.select("ref", "relation", "bound_in", "head", "rest"), "ref"))

    def given(reached: DataFrame) -> DataFrame:
        """(scope, name, type_id) of variables (ref, relation, at) whose chain has led to `at`."""
        made = infer.call_results(reached.where("relation = 'call'").select("ref", F.col("at").alias("target_id")), definitions, named).select("ref", "type_id")
        noted = reached.where("relation = 'annotation'").join(classes.withColumnRenamed("id", "at"), "at", "left_semi").select("ref", F.col("at").alias("type_id"))
        return spots.select("ref", "scope", "name").join(made.unionByName(noted), "ref").select("scope", "name", "type_id")

    found = new = written(given(known.where("record = 'variable'").select("ref", "relation", "at")))
    while not new.isEmpty():
        begun = spots.join(new.select(F.col("scope").alias("bound_in"), F.col("name").alias("head"), F.col("type_id").alias("at")), ["bound_in", "head"])
        reached = followed(begun.select("ref", "at", "rest")).where("at is not null and size(rest) = 0").join(spots.select("ref", "relation"), "ref")
        new = written(given(reached.select("ref", "relation", "at")).join(found.select("scope", "name"), ["scope", "name"], "left_anti"))
        found = found.unionByName(new)
    return written(found)
