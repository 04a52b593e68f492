"""Tables in the folder that all executors share, to cut the lineage of iterative operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder the cluster names. Where none is set, a local session has a temporary one; a cluster has none."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        where = f"{tempfile.gettempdir()}/skein-shared"
    return where.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def _clean_up() -> None:
    for path, spark in list(_made.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended
            return


atexit.register(_clean_up)


def written(df: DataFrame) -> DataFrame:
    """df, written and read again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/skein-{uuid.uuid4().hex[:12]}"
    _made[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
