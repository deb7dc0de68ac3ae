"""Suggestions by prefix, from indexed words or from past queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TERMS, POPULAR, RECENT_HOURS = 5, 10, 12


def suggest_terms(vocab: DataFrame, prefix: str | None, k: int = TERMS) -> DataFrame:
    """rank, word: indexed words that start with the prefix, an exact one first, then
    by alphabet. A blank prefix suggests nothing."""
    p = (prefix or "").strip().lower()
    rows = vocab.select("word").where(F.col("word").startswith(p) if p else F.lit(False)).distinct()
    order = [F.when(F.col("word") == p, 1).otherwise(3), F.col("word")]
    top = rows.orderBy(*order).limit(k)
    return top.select(F.row_number().over(W.orderBy(*order)).cast("long").alias("rank"), "word")


def prefix_table(words: DataFrame, k: int = POPULAR) -> DataFrame:
    """prefix, rank, word, freq: the k most frequent words of every prefix (ties by
    alphabet). words: word, freq; of a repeated word the largest freq counts. Each
    task keeps its own k before the shuffle."""
    own = words.where("length(word) > 0").groupBy("word").agg(F.max("freq").alias("freq"))
    ends = F.sequence(F.lit(1), F.length("word"))
    rows = own.select(F.explode(F.transform(ends, lambda n: F.substring("word", F.lit(1), n))).alias("prefix"), "word", "freq")
    rank = F.row_number().over(W.partitionBy("prefix").orderBy(F.desc("freq"), "word"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("prefix", F.col("rank").cast("long").alias("rank"), "word", "freq")


def suggest_popular(words: DataFrame, prefix: str, k: int = POPULAR) -> DataFrame:
    """rank, word, freq for one prefix, without the table of all prefixes."""
    own = words.where(F.col("word").startswith(prefix)).groupBy("word").agg(F.max("freq").alias("freq"))
    top = own.orderBy(F.desc("freq"), "word").limit(k)
    return top.select(F.row_number().over(W.orderBy(F.desc("freq"), "word")).cast("long").alias("rank"), "word", "freq")


def recent_queries(log: DataFrame, now: datetime | Column, hours: int = RECENT_HOURS) -> DataFrame:
    """query, count of the log rows whose age in whole hours is at most `hours`."""
    at = now if isinstance(now, Column) else F.lit(now)
    kind = log.schema["last_added"].dataType.simpleString()
    rows = log.withColumn("_now", at.cast(kind))
    return rows.where(F.expr(f"timestampdiff(HOUR, last_added, _now) <= {int(hours)}")).select("query", "count")
