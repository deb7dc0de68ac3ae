"""Stored tables: documents, links, and a query log, as Parquet below one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from .scratch import Rounds, numbered


#: Tables of texts, and their keys.
TEXTS = {"documents": "doc_id", "pages": "page_id"}


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table of fewer splits than there are cores (one small file, one row group)
    is dealt out by key; larger ones are left as their splits are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, TEXTS[name]) if name in TEXTS else df


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def save_crawl(docs: DataFrame, links: DataFrame, path: str, commit: int) -> None:
    """Append a crawl's documents and links under one commit number. Links go first:
    readers take documents as the list of what is committed."""
    links.write.mode("overwrite").parquet(f"{path}/links/commit={commit}")
    docs.write.mode("overwrite").parquet(f"{path}/documents/commit={commit}")


def save_queue(queue: DataFrame, path: str, commit: int) -> None:
    """The urls left to fetch after a commit."""
    queue.write.mode("overwrite").parquet(f"{path}/queue/commit={commit}")


def load_queue(spark: SparkSession, path: str) -> DataFrame | None:
    """The last queue that was saved."""
    kept = read_or_empty(spark, f"{path}/queue", T.StructType([*schemas.QUEUE.fields, T.StructField("commit", T.IntegerType())]))
    last = kept.agg(F.max("commit")).first()[0]
    return None if last is None else kept.where(F.col("commit") == last).select("seq", "url")


def last_commit(spark: SparkSession, path: str) -> int:
    """The last commit of documents, 0 if there is none."""
    docs = read_or_empty(spark, f"{path}/documents", "doc_id long, commit int")
    return docs.agg(F.coalesce(F.max("commit"), F.lit(0))).first()[0]


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, f"{path}/documents", schemas.DOCUMENTS)


def load_links(spark: SparkSession, path: str) -> DataFrame:
    docs = load_documents(spark, path).select("doc_id")
    return read_or_empty(spark, f"{path}/links", schemas.LINKS).join(docs, "doc_id", "left_semi")


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, f"{path}/query_log", schemas.QUERY_LOG)


def with_ids(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (url, ...) plus doc_id: the smallest id that known (doc_id, url) has for
    the url, or a new one behind the largest, in order of url."""
    rounds = Rounds(rows.sparkSession)
    old = known.groupBy("url").agg(F.min("doc_id").alias("doc_id"))
    last = known.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    fresh = rows.select("url").distinct().join(old, "url", "left_anti")
    fresh = numbered(fresh, [F.col("url")], "_number", lambda df: rounds.keep(df, drop_before=False))
    return rows.join(old.unionByName(fresh.select((F.col("_number") + last).alias("doc_id"), "url")), "url")
