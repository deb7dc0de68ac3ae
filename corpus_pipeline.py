"""Corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing of
sources, sharding. Every stage reads all that the one before kept, and is written
as Parquet in the shared folder before the next one reads it.

Stages but the last return the columns of documents. A toxic document goes (the
classifier learns from the labelled training rows; the decision holds for all). Of
each group of near-duplicates the smallest id stays. A document that holds a test
item goes. Mixing repeats a document as often as the mix takes it, and drops those
it doesn't take. Sharding returns doc_id, copy number, size, shard and slot.
Rows of a null id pass through toxicity and decontamination like others and are
each their own group to the near-duplicate stage; of repeated rows of one id all stay
there, and the mix takes each by itself. Null and empty texts pass toxicity, are near
duplicates of each other, hold no item, and the mix takes none of them as they have
no words. Very long texts are read whole by every stage. Further columns pass through
all stages but the last, whatever their names. Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontam, mixing, sharding, simhash, toxicity
from gleaner.llm.common import Scratch, batches, held_out, table, text_of, texts

TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    batches(spark)
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id")).select("doc_id", F.col("toxic").alias("y"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.where(F.col("score") < TOXIC_FROM).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    batches(spark)
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    batches(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    batches(spark)
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = sharding.shard_table(docs.select("doc_id", "text", F.crc32(text_of().cast("binary")).alias("text_crc32")))
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES: list[tuple[str, Callable]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("sharding", shard),
]

#: Learned scores, component search and the random walk of the mix are no SQL; tests
#: hold the kept rows of every stage against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), texts(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        new = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return new
        kept = scratch.write(new, name)
        if k:
            scratch.drop(docs)
        docs = kept
    return docs
