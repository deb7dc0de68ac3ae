"""Scores, order and pages of results."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.query import Term

TFIDF_SHARE, RANK_SHARE = 0.7, 0.3
PAGE_SIZE, LARGEST_PAGE = 10, 100


def times(term: Column, words: list[Term]) -> Column:
    """How often a term stands in the query."""
    out = F.lit(0)
    for key, n in Counter(t.key for t in words).items():
        out = F.when(term == key, n).otherwise(out)
    return out


def scores(matches: DataFrame, words: list[Term], page_rank: DataFrame | None = None, importance: float = 1.0) -> DataFrame:
    """doc_id, score: a share of the sum of tf * idf over the query's words and a
    share of the page rank (0 where there is none)."""
    part = F.col("tf") * F.col("idf") * importance * times(F.col("term"), words)
    out = matches.groupBy("doc_id").agg(F.sum(part).alias("tfidf"))
    if page_rank is None:
        rank = F.lit(0.0)
    else:
        out, rank = out.join(page_rank.select("doc_id", "page_rank"), "doc_id", "left"), F.coalesce("page_rank", F.lit(0.0))
    return out.select("doc_id", F.round(TFIDF_SHARE * F.col("tfidf") + RANK_SHARE * rank, 9).alias("score"))


def page_args(page: int, size: int) -> tuple[int, int]:
    """A negative page is an error; a size out of bounds is the usual one."""
    if page < 0:
        raise ValueError("page must not be negative")
    return page, size if 0 < size <= LARGEST_PAGE else PAGE_SIZE


def page_of(ranked: DataFrame, page: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """rank, doc_id, score of one page, best first, ties by id: one distributed
    top-k; only the page's rows are numbered."""
    page, size = page_args(page, size)
    rows = ranked.orderBy(F.desc("score"), "doc_id").offset(page * size).limit(size)
    rank = F.row_number().over(W.orderBy(F.desc("score"), "doc_id")) + page * size
    return rows.select(rank.cast("long").alias("rank"), "doc_id", "score")
