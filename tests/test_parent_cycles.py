"""Nodes whose chain of parents never ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import validate


def test_cycles_chains_and_what_leads_to_them(spark, monkeypatch):
    kept, sizes = validate.written, []
    monkeypatch.setattr(validate, "written", lambda df: sizes.append((out := kept(df)).count()) or out)
    chain = [(k, k + 1) for k in range(100, 137)]  # ends
    ring = [(k, (k + 1) % 7) for k in range(7)]
    tail = [(k, k - 1) for k in range(11, 20)] + [(10, 3), (50, 50), (51, 50), (60, None), (None, 3), (61, 60), (62, 999)]
    got = sorted(r.id for r in validate.on_parent_cycles(spark.createDataFrame(chain + ring + tail, "id long, parent_id long")).collect())
    assert got == sorted([*range(7), *range(10, 20), 50, 51])
    leaves = spark.range(1000).select((F.col("id") + 1000).alias("id"), (F.col("id") % 5).alias("parent_id")).union(spark.createDataFrame(ring, "id long, parent_id long"))
    sizes.clear()
    bad = validate.on_parent_cycles(leaves)
    assert bad.count() == 1007
    assert sum(n > 7 for n in sizes) == 1 and len(sizes) <= 4  # leaves are not followed, and a round that loses nothing is the last
    assert "Broadcast" not in bad._jdf.queryExecution().executedPlan().toString()
