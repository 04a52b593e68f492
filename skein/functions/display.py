"""How nodes and edges are shown: labels, hashed places, languages, and what a pointer hits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The hash's start and factor, the ring and the grid of a layout, a label's length, a pointer's reach.
FNV_START, FNV_FACTOR = 2166136261, 16777619
RING, RING_STEP, GRID_X, GRID_Y = 150, 34, 820, 620
LABEL, REACH = 28, 7.0


def fnv1a(text: Column) -> Column:
    """FNV-1a of 32 bits over the characters' codes (those beyond 65535 as their two halves)."""

    def eat(h: Column, c: Column) -> Column:
        return F.pmod(h.bitwiseXOR(c) * F.lit(FNV_FACTOR), F.lit(2**32))

    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wide = lambda c: F.array(F.lit(0xD800) + F.shiftright(c - 0x10000, 10), F.lit(0xDC00) + (c - 0x10000).bitwiseAND(F.lit(0x3FF)))
    units = F.flatten(F.transform(codes, lambda c: F.when(c < 0x10000, F.array(c)).otherwise(wide(c).cast("array<long>"))))
    return F.aggregate(units, F.lit(FNV_START).cast("long"), eat)


def places(nodes: DataFrame) -> DataFrame:
    """(id, depth, sibling, angle, radius, column, row) of nodes: modules stand in a grid, others on a ring around their parent.

    The grid's width is the root of the number of modules. Siblings are counted in the order of ids.
    """
    modules = nodes.where("kind = 'module'").select("id")
    width = modules.agg(F.greatest(F.lit(1), F.ceil(F.sqrt(F.count(F.lit(1))))).cast("long").alias("_width"))
    from skein.operators.rollup import with_ordinals

    grid = with_ordinals(modules).crossJoin(width)  # a table of one row
    grid = grid.select("id", F.pmod("ordinal", "_width").alias("column"), F.floor(F.col("ordinal") / F.col("_width")).alias("row"))
    order = Window.partitionBy("parent_id").orderBy("id")
    sibling = F.when(F.col("parent_id").isNotNull(), F.row_number().over(order) - 1).otherwise(0)
    ring = nodes.select("id", "kind", "parent_id").withColumn("sibling", sibling).where("kind <> 'module'")
    ring = ring.select("id", "parent_id", "sibling", F.pmod(fnv1a(F.col("id")), F.lit(360)).alias("angle"), (F.lit(RING) + F.pmod("sibling", F.lit(5)) * RING_STEP).alias("radius"))
    none = lambda *names: [F.lit(None).cast("long").alias(n) for n in names]
    cols = ["id", "parent_id", "sibling", "angle", "radius", "column", "row"]
    first = grid.select("id", F.lit(None).cast("string").alias("parent_id"), *none("sibling", "angle", "radius"), "column", "row")
    return first.select(cols).unionByName(ring.select("id", "parent_id", *[F.col(c).cast("long").alias(c) for c in ("sibling", "angle", "radius")], *none("column", "row")))


def positions(nodes: DataFrame, modules: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(id, x, y): the grid, then ring by ring outwards, then what a layout says. modules: (id, module_id)."""
    from skein.sources.shared import written

    at = written(places(nodes).join(modules.select("id", "module_id"), "id", "left"))
    done = written(at.where(F.col("column").isNotNull()).select("id", (F.col("column") * GRID_X).cast("double").alias("x"), (F.col("row") * GRID_Y).cast("double").alias("y")))
    rest = at.where(F.col("column").isNull())
    known = nodes.select(F.col("id").alias("_base"))
    rest = written(rest.join(known, F.col("parent_id") == F.col("_base"), "left").withColumn("_base", F.coalesce("_base", "module_id")))
    turn = F.col("angle") * math.pi / 180

    def placed(rows: DataFrame, bases: DataFrame, how: str) -> DataFrame:
        both = rows.join(bases.select(F.col("id").alias("_base"), F.col("x").alias("_x"), F.col("y").alias("_y")), "_base", how)
        x = F.coalesce("_x", F.lit(0.0)) + F.cos(turn) * F.col("radius") + F.pmod("sibling", F.lit(4)) * 45
        y = F.coalesce("_y", F.lit(0.0)) + F.sin(turn) * F.col("radius") + F.floor(F.col("sibling") / 4) * 45
        return both.select("id", x.alias("x"), y.alias("y"))

    level, out = done, done
    while True:
        new = written(placed(rest, level, "inner"))
        if new.isEmpty():
            break
        out, level = out.union(new), new
        rest = written(rest.join(new.select("id"), "id", "left_anti"))
    out = out.union(placed(rest, done.limit(0), "left"))  # what hangs on nothing that has a place
    if overrides is not None:
        said = overrides.select("id", F.col("x").alias("_x"), F.col("y").alias("_y"))
        out = out.join(said, "id", "left").select("id", F.coalesce("_x", "x").alias("x"), F.coalesce("_y", "y").alias("y"))
    return out


def label(kind: Column, file: Column, display_name: Column, qualified_name: Column, id_: Column) -> Column:
    """The name a node is shown by: a module's file, else the first of its names that isn't empty."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(F.when(kind == "module", some(file)), some(display_name), some(qualified_name), id_)


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def compact_label(kind: Column, text: Column, most: int = LABEL) -> Column:
    """A label of `most` characters at most: of a module the end stays, of others the beginning."""
    end = F.concat(F.lit("…"), F.right(text, F.lit(most - 1)))
    return F.when((kind == "module") & (F.length(text) > most), end).otherwise(shortened(text, most))


def span_text(span: Column) -> Column:
    part = lambda n: span[n].cast("string")
    return F.when(span.isNull(), "").otherwise(F.concat(part("start_line"), F.lit(":"), part("start_col"), F.lit("–"), part("end_line"), F.lit(":"), part("end_col")))


def language_of(extensions: Column, language: Column, indexed: Column, document: str | None) -> Column:
    """A node's language: its extension's, its own, the index's, or the document's unless that is mixed."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(F.get_json_object(extensions, "$.language")), some(language), some(indexed), F.lit(document if document != "mixed" else None).cast("string"))


def hit_edge(edges: DataFrame, x: float, y: float, reach: float = REACH) -> DataFrame:
    """The nearest edge to a point, nearer than `reach`: edges has (id, x1, y1, x2, y2) on the screen; ties go to the smaller id."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    long = dx * dx + dy * dy
    t = F.when(long == 0, 0.0).otherwise(F.least(F.greatest((dx * (x - F.col("x1")) + dy * (y - F.col("y1"))) / F.nullif(long, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    far = F.sqrt((F.lit(x) - F.col("x1") - t * dx) ** 2 + (F.lit(y) - F.col("y1") - t * dy) ** 2)
    return edges.withColumn("distance", far).where(F.col("distance") < reach).orderBy("distance", "id").limit(1)


def hit_node(nodes: DataFrame, x: float, y: float, slop: float = 4.0) -> DataFrame:
    """The node drawn last whose box, a little widened, holds a point: nodes has (id, x, y, width, height, drawn)."""
    inside = (F.abs(F.col("x") - x) <= F.col("width") / 2 + slop) & (F.abs(F.col("y") - y) <= F.col("height") / 2 + slop)
    return nodes.where(inside).orderBy(F.desc("drawn")).limit(1)
