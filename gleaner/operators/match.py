"""Matching: words, phrases and boolean pairs, as rows doc_id, term, tf, idf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.query import Both, Component, Term
from .index import Index

GAP = 3


def match_words(index: Index, terms: tuple[Term, ...]) -> DataFrame:
    """Documents with any of the terms. The filter reaches the postings' scan. Stored
    postings have their idf; else the vocabulary side has a row a term."""
    keys = [t.key for t in terms]
    if index.buckets:
        return index.postings_of(keys).select("doc_id", F.col("word").alias("term"), "tf", "idf")
    posts = index.postings.where(F.col("word").isin(keys)).select("word", "doc_id", "tf")
    idf = index.vocab.where(F.col("word").isin(keys)).select("word", "idf").limit(max(1, len(keys)))
    return posts.join(F.broadcast(idf), "word").select("doc_id", F.col("word").alias("term"), "tf", "idf")


def phrase_ok(positions: list[Column], gap: int = GAP) -> Column:
    """Whether some start in the first list can be followed through all others: in
    each list, places are walked in order; a place counts if it lies 1 to `gap`
    behind the current one (once one counted: less than `gap`), and becomes current."""
    if len(positions) == 1:
        return F.size(positions[0]) > 0

    def follow(state: Column, places: Column) -> Column:
        start = F.struct(state["cur"].alias("cur"), F.lit(False).alias("found"))

        def walk(a: Column, p: Column) -> Column:
            near = (p > a["cur"]) & (p <= a["cur"] + gap) & (~a["found"] | (p < a["cur"] + gap))
            return F.when(near, F.struct(p.alias("cur"), F.lit(True).alias("found"))).otherwise(a)

        return F.aggregate(places, start, walk, lambda a: F.struct(a["cur"].alias("cur"), (state["ok"] & a["found"]).alias("ok")))

    rest = F.array(*positions[1:])
    return F.exists(positions[0], lambda s: F.aggregate(rest, F.struct(s.alias("cur"), F.lit(True).alias("ok")), follow, lambda a: a["ok"]))


def phrase_docs(index: Index, terms: tuple[Term, ...], gap: int = GAP) -> DataFrame:
    """doc_id of the documents that hold all terms, in order and close together."""
    keys = [t.key for t in terms]
    rows = index.postings_of(keys)
    places = [F.max(F.when(F.col("word") == k, F.col("positions"))).alias(f"p{i}") for i, k in enumerate(keys)]
    by_doc = rows.groupBy("doc_id").agg(F.count_distinct("word").alias("n"), *places).where(F.col("n") == len(keys))
    return by_doc.where(phrase_ok([F.col(f"p{i}") for i in range(len(keys))], gap)).select("doc_id")


def match_phrase(index: Index, terms: tuple[Term, ...], gap: int = GAP) -> DataFrame:
    return match_words(index, terms).join(phrase_docs(index, terms, gap), "doc_id", "left_semi")


def match_component(index: Index, c: Component) -> DataFrame:
    if not c.terms:
        return match_words(index, (Term("", ""),)).limit(0)
    return match_phrase(index, c.terms) if c.phrase else match_words(index, c.terms)


def match_and(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select("doc_id").distinct(), "doc_id", "left_semi")


def match_not(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select("doc_id").distinct(), "doc_id", "left_anti")


def match_or(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both; for a document and term that both have, the right one's."""
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    last = F.row_number().over(W.partitionBy("doc_id", "term").orderBy(F.desc("_side")))
    return both.withColumn("_n", last).where("_n = 1").drop("_n", "_side")


def match(index: Index, tree: Component | Both) -> DataFrame:
    if isinstance(tree, Component):
        return match_component(index, tree)
    left, right = match_component(index, tree.left), match_component(index, tree.right)
    return {"AND": match_and, "OR": match_or, "NOT": match_not}[tree.op](left, right)


def match_count(matches: DataFrame) -> DataFrame:
    """One row: the number of matching documents."""
    return matches.agg(F.count_distinct("doc_id").alias("n_docs"))
