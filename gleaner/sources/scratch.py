"""Tables in the folder that driver and executors share: they cut lineage between
rounds and survive the loss of an executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where the session names none, a local folder will do
    for a local master only: executors elsewhere would not see it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session may have ended
        pass


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of a query go as soon as its result is written."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Rounds:
    """Writes each round of an iteration and removes the one before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.last = spark, f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}", []
        atexit.register(delete_at_exit, spark, self.root)

    def keep(self, df: DataFrame, drop_before: bool = True) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        with shuffles_dropped(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        if drop_before:
            for p in self.last:
                delete(self.spark, p)
            self.last = [path]
        return out


def numbered(df: DataFrame, by: list[Column], name: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df plus name: 1, 2, ... in the order of `by`. Rows are dealt into ranges, which
    `keep` writes, and numbered range by range behind the counts of those before, so
    no task gets all rows."""
    ranges = keep(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    counts = ranges.groupBy("_range").count()
    before = F.coalesce(F.sum("count").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_range", before.alias("_before"))  # a row a range
    place = F.row_number().over(W.partitionBy("_range").orderBy(*by))
    out = ranges.withColumn("_place", place).join(F.broadcast(counts), "_range")
    return out.withColumn(name, (F.col("_place") + F.col("_before")).cast("long")).drop("_range", "_place", "_before")
