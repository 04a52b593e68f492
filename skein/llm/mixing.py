"""Mixing sources to target weights along a time-varying curriculum.

A source's weight schedule is integrated over training time, which gives its cumulative demand of
words; a document's place in its source's word order is pushed through the inverse of that integral
to give its training position, and the mix is sorted by position. DataFrame functions only.

The running word count within a source is a prefix sum in two levels: sums of (source, hash bucket)
are added up in a small window, and a window inside each bucket adds the rest, so a source that holds
a third of all rows is dealt over BUCKETS tasks.

Defined results: a null text has size 0; null is a source of its own, last in order; rows alike take
part once each; an empty table gives no rows; sources without words get target 0; further columns
pass through, and internal names start with _sk_.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import WORD, Scratch, table

#: Hash buckets of a source, a power of two; a bucket's documents are summed up by one task.
BUCKET_BITS = 12
#: No source is taken more often than this.
MOST_PASSES = 3
_HEX = 15


def default_weight(rank: Column) -> Column:
    """1, 2, 3, repeating, by the source's rank from 1."""
    return (rank - 1) % 3 + 1


def default_schedule(weight: Column) -> Column:
    """Relative weight at the start, the middle and the end of training: weight 3 rises, weight 1 falls; each has mean 1."""
    tilt = (weight - 2) * F.lit(0.5)
    return F.array(*[F.struct(F.lit(t).alias("t"), (1 + tilt * (2 * t - 1)).cast("double").alias("w")) for t in (0.0, 0.5, 1.0)])


def _segments(knots: Column) -> Column:
    """Pieces of a piecewise linear schedule, each with the area before it (trapezoid rule, exact here)."""
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(knots) - 1),
        lambda i: F.struct(
            F.element_at(knots, i)["t"].alias("t"),
            (F.element_at(knots, i + 1)["t"] - F.element_at(knots, i)["t"]).alias("h"),
            F.element_at(knots, i)["w"].alias("a"),
            F.element_at(knots, i + 1)["w"].alias("b"),
        ),
    )
    return F.transform(
        pieces,
        lambda p, i: F.struct(
            p["t"].alias("t"), p["h"].alias("h"), p["a"].alias("a"), p["b"].alias("b"),
            F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0.0), lambda s, q: s + q["h"] * (q["a"] + q["b"]) / 2).alias("before"),
        ),
    )


def invert(segments: Column, share: Column) -> Column:
    """Time by which `share` (0 to 1) of the schedule's integral has passed."""
    last = F.element_at(segments, -1)
    area = share * (last["before"] + last["h"] * (last["a"] + last["b"]) / 2)
    s = F.element_at(F.filter(segments, lambda p: (p["before"] <= area) | (p["t"] == 0.0)), -1)
    rest = area - s["before"]
    root = F.sqrt(F.greatest(F.lit(0.0), s["a"] * s["a"] + 2 * (s["b"] - s["a"]) * rest / s["h"]))
    down = s["a"] + root
    return F.when(down > 0, F.least(F.lit(1.0), s["t"] + 2 * rest / down)).otherwise(s["t"])


def targets(sizes: DataFrame, weight: Callable[[Column], Column] = default_weight, most: int = MOST_PASSES) -> DataFrame:
    """From (_sk_source key, source_size): the target of each source, one row each.

    All words are shared out by weight; a source stops at `most` times its size, and what it can't take
    is shared again. In order of most * size / weight the sources that stop are a prefix, so one window
    over the sources finds them; sums are exact decimals.
    """
    whole = "decimal(38,0)"
    ranked = sizes.withColumn("_sk_w", weight(F.row_number().over(Window.orderBy("_sk_source"))).cast("long"))
    ranked = ranked.withColumn("_sk_cap", (F.col("source_size") * most).cast(whole))
    by_ratio = Window.orderBy((F.col("_sk_cap").cast("double") / F.col("_sk_w")), "_sk_source")
    everything = Window.partitionBy()
    ranked = ranked.withColumns(
        {
            "_sk_all": F.sum("source_size").over(everything).cast(whole),
            "_sk_before": F.coalesce(F.sum("_sk_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(whole),
            "_sk_left": F.sum("_sk_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    stops = F.col("_sk_cap").cast("double") * F.col("_sk_left") <= (F.col("_sk_all") - F.col("_sk_before")).cast("double") * F.col("_sk_w")
    ranked = ranked.withColumn("_sk_stops", stops)
    ranked = ranked.withColumns(
        {
            "_sk_used": F.coalesce(F.sum(F.when(F.col("_sk_stops"), F.col("_sk_cap"))).over(everything), F.lit(0)).cast(whole),
            "_sk_open": F.sum(F.when(~F.col("_sk_stops"), F.col("_sk_w"))).over(everything),
        }
    )
    rest = (F.col("_sk_all") - F.col("_sk_used")).cast("double") * F.col("_sk_w") / F.col("_sk_open")
    return ranked.select("_sk_source", "source_size", F.col("_sk_w").alias("_sk_weight"), F.when(F.col("_sk_stops"), F.col("_sk_cap").cast("double")).otherwise(rest).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Callable[[Column], Column] = default_weight,
    schedule: Callable[[Column], Column] = default_schedule,
    most: int = MOST_PASSES,
) -> DataFrame:
    """docs with size, source_size, target, passes (times taken), taken (words) and positions (training times, an array).

    In each source, documents stand in an order of hashes of their ids. The source's word stream is that
    order, repeated; the mix takes its first `target` words, a document being in if its middle word is.
    Columns of docs with the names of results give way to them.
    """
    docs = docs.drop("size", "source_size", "target", "passes", "taken", "positions")
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    place = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, _HEX), 16, 10).cast("long")
    # s sorts before z: null comes last, and no source's key can equal its key
    source = F.when(F.col(source_col).isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    # the tie-breaker is taken before the shuffle, so the text moves only if the caller asks for it
    rows = docs.withColumns({"size": size, "_sk_source": source, "_sk_place": place, "_sk_tie": F.xxhash64(F.col(text_col))})
    rows = rows.withColumn("_sk_bucket", F.shiftright("_sk_place", 4 * _HEX - BUCKET_BITS))
    # written, so that the texts are counted once for all sums: a row for each source and bucket at most
    buckets = Scratch(docs.sparkSession, "mixing").keep(rows.groupBy("_sk_source", "_sk_bucket").agg(F.sum("size").alias("_sk_sum")), "buckets")
    so_far = Window.partitionBy("_sk_source").orderBy("_sk_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("_sk_source", "_sk_bucket", F.coalesce(F.sum("_sk_sum").over(so_far), F.lit(0)).alias("_sk_offset"))
    wanted = targets(buckets.groupBy("_sk_source").agg(F.sum("_sk_sum").alias("source_size")), weight, most)
    wanted = wanted.withColumn("_sk_segments", _segments(schedule(F.col("_sk_weight"))))
    starts = offsets.join(wanted, "_sk_source")
    inside = Window.partitionBy("_sk_source", "_sk_bucket").orderBy("_sk_place", F.col(id_col), "size", "_sk_tie")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.join(starts, ["_sk_source", "_sk_bucket"]).withColumn("_sk_at", F.col("_sk_offset") + before)
    middle = [2 * (F.col("_sk_at") + p * F.col("source_size")) + F.col("size") for p in range(most)]
    passes = sum((F.when(m.cast("double") <= 2 * F.col("target"), 1).otherwise(0) for m in middle), F.lit(0))
    out = out.withColumn("passes", F.when(F.col("size") > 0, passes).otherwise(0).cast("int"))
    at = F.transform(
        F.when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes") - 1)).otherwise(F.array().cast("array<int>")),
        lambda p: invert(F.col("_sk_segments"), F.least(F.lit(1.0), (F.col("_sk_at") + p * F.col("source_size")).cast("double") / F.col("target"))),
    )
    out = out.withColumns({"taken": (F.col("passes") * F.col("size")).cast("long"), "positions": at})
    return out.drop("_sk_source", "_sk_bucket", "_sk_place", "_sk_tie", "_sk_offset", "_sk_at", "_sk_segments", "_sk_weight")


def in_training_order(mixed: DataFrame) -> DataFrame:
    """One row for each time a document is taken, range-sorted by position (ties by id)."""
    out = mixed.withColumn("_sk_position", F.explode("positions"))
    return out.orderBy("_sk_position", *[c for c in ("doc_id",) if c in mixed.columns])


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    out = out.withColumn("_sk_position", F.coalesce(F.get("positions", F.lit(0)), F.lit(1.0)))
    return out.orderBy("_sk_position", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "passes")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, chr(1114111)) AS src, source IS NULL AS no_source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents),
s AS (SELECT src, no_source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src, no_source),
w AS (SELECT *, (row_number() OVER (ORDER BY no_source, src) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM s),
r AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, no_source, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
    CAST(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, no_source, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w_left
  FROM w),
c AS (SELECT *, CAST(cap AS DOUBLE) * w_left <= CAST(total - before AS DOUBLE) * w AS stops FROM r),
u AS (
  SELECT *, CAST(coalesce(sum(CASE WHEN stops THEN cap END) OVER (), 0) AS BIGINT) AS used,
    CAST(sum(CASE WHEN NOT stops THEN w END) OVER () AS BIGINT) AS w_open
  FROM c),
t AS (SELECT src, no_source, source_size, CASE WHEN stops THEN CAST(cap AS DOUBLE) ELSE CAST(total - used AS DOUBLE) * w / w_open END AS target FROM u),
a AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.src, d.no_source ORDER BY substr(d.place, 1, 15), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM d JOIN t ON d.src = t.src AND d.no_source = t.no_source),
p AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE
    CASE WHEN CAST(2 * pos + size AS DOUBLE) <= 2 * target THEN 1 ELSE 0 END
    + CASE WHEN CAST(2 * (pos + source_size) + size AS DOUBLE) <= 2 * target THEN 1 ELSE 0 END
    + CASE WHEN CAST(2 * (pos + 2 * source_size) + size AS DOUBLE) <= 2 * target THEN 1 ELSE 0 END END AS n
  FROM a)
SELECT doc_id, size, source_size, target, CAST(n * size AS BIGINT) AS taken, CAST(n AS INTEGER) AS passes FROM p
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix in training order, a document as often as it is taken, with the columns it came with.

    The order is that of the files it is written to and of their rows, which the next stage reads.
    """
    del spark, sf_dir
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_sk_row")
    return in_training_order(mix(docs.select("doc_id", "text", "source", whole))).select("_sk_row.*")
