"""What the operators of this subpackage share: table access, shared scratch tables, row keys."""

from __future__ import annotations

import atexit
import gc
import math
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: The row key of an operator that has to find a row again: 128 bits, of the id and the text.
KEY = "_sk_key"

_scratch: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share. Where none is set, a local session has a temporary one; a cluster has none."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        where = f"{tempfile.gettempdir()}/skein-shared"
    return where.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _clean_up() -> None:
    for path, spark in list(_scratch.items()):
        try:
            drop_path(spark, path)
        except Exception:  # the session has gone; the folder's owner clears it
            return


atexit.register(_clean_up)


class Scratch:
    """Tables of one run of an operator, written to the shared folder; a lost executor costs only the tasks it ran."""

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/skein-{what}-{uuid.uuid4().hex[:12]}"
        _scratch[self.root] = spark
        self.n = 0

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes df and reads it again, which cuts its lineage."""
        self.n += 1
        path = self.path(f"{name}-{self.n}")
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._sk_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        drop_path(self.spark, df._sk_path)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of plans that nothing refers to any more, now rather than at some later collection."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def row_key(*names: str) -> Column:
    """128 bits of the columns' values. Rows alike in them share a key, and are treated alike."""
    told = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (F.col(n).cast("string") for n in names)]
    return F.unhex(F.md5(F.concat(*told)))


def by_bytes(sizes: list[int], most: int) -> Iterator[slice]:
    """Runs of rows of `most` bytes at most, or of one row that is longer."""
    begin = held = 0
    for k, n in enumerate(sizes):
        if k > begin and held + n > most:
            yield slice(begin, k)
            begin, held = k, 0
        held += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def ceil_log(miss: float, p: float) -> int:
    """The runs after which a pair found with probability p in each is missed with probability miss at most."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - p)))
