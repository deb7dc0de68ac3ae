"""The inverted index: weighted, positional postings and a vocabulary.

Blocks of a document stay in one row until their words are exploded, so a
document's token total travels with its words instead of being joined back.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.porter import stems
from ..functions.text import STOP_WORDS, block_weight, document_blocks, is_valid_word, tokens
from ..sources.scratch import Rounds

#: Vocabulary rows up to which a stem table is broadcast.
BROADCAST_WORDS = 1_000_000
#: Folders that a stored index is dealt to by word: a lookup reads one for each word.
BUCKETS = 64


@dataclass
class Index:
    """postings: word, doc_id, tf, importance, positions; vocab: word, df, idf."""

    postings: DataFrame
    vocab: DataFrame
    stemmed: bool = False
    stop: frozenset[str] = STOP_WORDS
    #: Size of the corpus, if postings are all of it.
    n_docs: int | None = None
    #: Of a stored index; its postings have idf and bucket as well.
    buckets: int | None = None

    def write(self, path: str, buckets: int = BUCKETS, splits: int = 1) -> None:
        """Postings with the idf of their word, by bucket of the word and sorted by word:
        a lookup opens one folder a word and skips all row groups but a few. More
        buckets for larger corpora keep a bucket one task's work; splits cut each by
        document as well, for words that most documents have."""
        spark = self.postings.sparkSession
        posts = Rounds(spark).keep(self.postings)  # texts are read once, for postings and vocabulary
        vocab = Rounds(spark).keep(self.vocab if self.n_docs is None else vocabulary(posts, self.n_docs))
        idf = vocab.select("word", "idf")
        idf = F.broadcast(idf) if vocab.count() <= BROADCAST_WORDS else idf
        posts = posts.join(idf, "word").withColumn("bucket", bucket_of(F.col("word"), buckets))
        dealt = posts.repartition(buckets * splits, "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(splits)))
        dealt.sortWithinPartitions("bucket", "word", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        vocab.repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").parquet(f"{path}/vocab")
        spark.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{path}/layout")

    @classmethod
    def read(cls, spark: SparkSession, path: str, stemmed: bool = False) -> Index:
        buckets = spark.read.parquet(f"{path}/layout").first()[0]
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/vocab"), stemmed, buckets=buckets)

    def postings_of(self, words: list[str]) -> DataFrame:
        """The postings of some words."""
        rows = self.postings
        if self.buckets and words:
            # folded to literals, so that only these folders are listed and read
            asked = reduce(lambda a, w: a | (F.col("bucket") == bucket_of(F.lit(w), self.buckets)), words[1:], F.col("bucket") == bucket_of(F.lit(words[0]), self.buckets))
            rows = rows.where(asked)
        return rows.where(F.col("word").isin(words))


def bucket_of(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def blocks_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Plain texts as rows of blocks."""
    return docs.select(F.col(key).alias("doc_id"), document_blocks(F.col(text)).alias("blocks"))


def occurrences(blocks: DataFrame, stop: Iterable[str] | None = STOP_WORDS) -> DataFrame:
    """doc_id, total (tokens that count in the document), word, position, weight.
    Positions count from 0 in every block."""
    read = F.transform("blocks", lambda b: F.struct(block_weight(b["tag"]).alias("weight"), tokens(b["text"], stop).alias("words")))
    rows = blocks.select("doc_id", read.alias("read"))
    rows = rows.withColumn("total", F.aggregate("read", F.lit(0).cast("long"), lambda a, b: a + F.size(b["words"])))
    # outer explodes: for inner ones the optimizer adds a filter that reads every text twice
    rows = rows.select("doc_id", "total", F.explode_outer("read").alias("block"))
    rows = rows.select("doc_id", "total", F.col("block.weight").alias("weight"), F.posexplode_outer("block.words").alias("position", "word"))
    return rows.where("word IS NOT NULL")


def stemmed_postings(found: DataFrame, words: DataFrame, stop: Iterable[str] | None = STOP_WORDS) -> DataFrame:
    """Postings by stem. found: occurrences, dealt by document; words: the distinct
    words, each of which is stemmed once. Words of a document are counted before stems
    are looked up, and nothing is shuffled but a vocabulary too large to broadcast. The
    total counts only tokens whose stem is still a valid word."""
    table = Rounds(words.sparkSession).keep(stems(words).withColumn("counts", is_valid_word(F.col("stem"), stop)))
    n = table.count()
    by = found.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.max("weight").alias("importance"), F.collect_set("position").alias("positions"))
    rows = by.join(F.broadcast(table) if n <= BROADCAST_WORDS else table, "word")
    total = F.coalesce(F.sum(F.when(F.col("counts"), F.col("n"))).over(W.partitionBy("doc_id")), F.lit(0))
    rows = rows.withColumn("total", total).groupBy("doc_id", "stem", "total").agg(F.sum("weight").alias("weight"), F.max("importance").alias("importance"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"))
    return rows.select(F.col("stem").alias("word"), "doc_id", _tf().alias("tf"), "importance", "positions")


def _tf() -> Column:
    return F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(F.col("weight"))


def postings(found: DataFrame) -> DataFrame:
    """word, doc_id, tf (weighted occurrences over the document's total), importance
    (largest weight) and sorted distinct positions."""
    by = found.groupBy("word", "doc_id", "total").agg(F.sum("weight").alias("weight"), F.max("weight").alias("importance"), F.array_sort(F.collect_set("position")).alias("positions"))
    return by.select("word", "doc_id", _tf().alias("tf"), "importance", "positions")


def vocabulary(posts: DataFrame, n_docs: int) -> DataFrame:
    """word, df and idf = log10(N / df)."""
    df = posts.groupBy("word").agg(F.count("*").alias("df"))  # a posting is a word and a document
    return df.withColumn("idf", F.log10(F.lit(float(n_docs)) / F.col("df")) + F.lit(0.0))


def build_index(blocks: DataFrame, n_docs: int | None = None, stop: frozenset[str] = STOP_WORDS, stem: bool = False, whole: bool = False) -> Index:
    """n_docs: size of the corpus, all rows by default (also those without words); give
    it where blocks are costly to make, as they are counted.
    whole: all postings are wanted, so texts are shuffled by document once and
    their words never; else filters on words come first and few rows are shuffled."""
    found = occurrences(blocks.repartition("doc_id") if whole or stem else blocks, stop)
    posts = stemmed_postings(found, occurrences(blocks, stop).select("word").distinct(), stop) if stem else postings(found)
    n = blocks.count() if n_docs is None else n_docs
    return Index(posts, vocabulary(posts, n), stem, stop, n)


def merge_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """Postings after documents were indexed again: theirs replace the old ones."""
    return old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)
