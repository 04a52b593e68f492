"""References of scripts and style sheets to elements, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matches(references: DataFrame, elements: DataFrame) -> DataFrame:
    """references (ref, selector) with every element, of any file, that a simple selector names; one row per match.

    #id by id, .class by membership, anything else by tag without regard to case. status: resolved,
    unresolved (nothing fits) or unsupported (the selector is not simple). Elements are listed under all
    names they answer to, so one equality join serves the three kinds.
    """
    simple = F.col("selector").rlike(r"^[#.]?[A-Za-z_][\w-]*$")
    key = F.when(F.col("selector").rlike("^[#.]"), F.col("selector")).otherwise(F.lower("selector"))
    asked = references.withColumns({"_simple": simple, "_key": F.when(simple, key)})
    dom_id = F.when(F.coalesce(F.col("dom_id"), F.lit("")) != "", F.array(F.concat(F.lit("#"), "dom_id"))).otherwise(F.array().cast("array<string>"))
    names = F.array_distinct(F.concat(F.array(F.lower("tag")), dom_id, F.transform(F.coalesce("classes", F.array().cast("array<string>")), lambda c: F.concat(F.lit("."), c))))
    named = elements.select(F.explode(names).alias("_key"), F.col("file").alias("element_file"), "element")
    out = asked.join(named, "_key", "left")
    status = F.when(~F.col("_simple"), "unsupported").when(F.col("element").isNull(), "unresolved").otherwise("resolved")
    return out.withColumn("status", status).drop("_simple", "_key")


def styles(rules: DataFrame, elements: DataFrame) -> DataFrame:
    """Rules (file, selector, start) with the elements they style; a simple rule that fits nothing gives no row."""
    found = matches(rules.withColumn("ref", F.xxhash64("file", "selector", "start")), elements)
    return found.where("status <> 'unresolved'").drop("ref")
