"""Rows without their node stream past a table of the nodes' ids."""

from __future__ import annotations

from skein.operators import validate


def test_rows_are_not_sorted_or_broadcast(spark):
    rows = spark.createDataFrame([("e1", "a"), ("e2", "z"), ("e3", None), ("e2", "z")], "id string, key string")
    nodes = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = validate.dangling(rows, "key", nodes, "rule")
        assert sorted(map(tuple, found.collect())) == [("rule", "e2"), ("rule", "e2")]
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
