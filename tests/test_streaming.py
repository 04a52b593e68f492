from __future__ import annotations

from skein.streaming import counts

SCHEMA = "code string, severity string"


def test_counts_follow_a_stream(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run = lambda: counts.follow(spark.readStream.schema(SCHEMA).parquet(source), ["code", "severity"], folder).awaitTermination(60)
    total = lambda: {(r.code, r.severity): r.n for r in counts.totals(spark, ["code", "severity"], folder).collect()}
    put([("a", "info"), ("a", "info"), ("b", None)])
    run()
    assert total() == {("a", "info"): 2, ("b", None): 1}
    run()
    put([("a", "info"), ("c", "error")])
    run()
    assert total() == {("a", "info"): 3, ("b", None): 1, ("c", "error"): 1}
