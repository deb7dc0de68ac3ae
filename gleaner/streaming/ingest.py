"""Streaming forms: pages that arrive are deduplicated and indexed batch by batch;
a query log is counted in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import build_index
from ..sources.html import html_blocks


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 100) -> DataFrame:
    """A Parquet table (one file or a folder of files) as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    schema: T.StructType = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def window_counts(events: DataFrame, by: str = "event_type", width: str = "1 hour", late: str = "30 days") -> DataFrame:
    """Rows and their latest time by tumbling window and key."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), by).agg(F.count("*").alias("n"), F.max("ts").alias("last_added"))
    return counted.select(F.col("window.start").alias("window_start"), by, "n", "last_added")


def keep_latest(counts: DataFrame, out: str, checkpoint: str, keys: tuple[str, ...] = ("window_start", "event_type")) -> DataFrame:
    """The counts of all windows of a stream that is read to its end. Every batch
    writes the windows that it changed (one that is tried again overwrites its own
    folder), the last word on a window counts, and the watermark ends its state."""

    def take(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = counts.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = counts.sparkSession.read.parquet(out)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest))


def drop_repeated(pages: DataFrame, html: str = "html") -> DataFrame:
    """A page whose content came before is dropped; state holds one hash a content."""
    return pages.withColumn("hash", F.md5(html)).dropDuplicates(["hash"])


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Take in all that is there and stop."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def index_stream(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append postings of arriving pages; a batch that is tried again overwrites its
    own folder, so nothing is indexed twice."""

    def take(batch: DataFrame, number: int) -> None:
        build_index(html_blocks(batch), 1).postings.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = pages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
