"""PageRank and its pieces over an edge table src, dst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import normalize_url
from ..sources.scratch import Rounds

DAMPING, EPSILON, MOST_ROUNDS = 0.85, 1e-5, 100


def link_graph(links: DataFrame, docs: DataFrame, normalize: bool = False) -> DataFrame:
    """Edges between documents: links (doc_id, link) that lead to a known url, as they
    stand or with links and urls normalized."""
    if normalize:
        links, docs = links.withColumn("link", normalize_url(F.col("link"))), docs.withColumn("url", normalize_url(F.col("url")))
    known = docs.select("url", F.col("doc_id").alias("dst")).where("url IS NOT NULL")
    return links.join(known, links.link == known.url).select(F.col("doc_id").alias("src"), "dst").distinct()


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count_distinct("dst").alias("degree"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def dangling(edges: DataFrame) -> DataFrame:
    """id of the nodes without an edge out."""
    return nodes_of(edges).join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def pagerank(edges: DataFrame, damping: float = DAMPING, eps: float = EPSILON, rounds: int = MOST_ROUNDS) -> DataFrame:
    """id, page_rank. Starts even; a node gets its share of what its neighbours give
    out, and everyone an equal part of what dangling nodes hold. Ends when no rank
    moves more than eps, or after `rounds`. Every round is a written table: cost is
    an equi-join and an aggregate over the edges."""
    keep = Rounds(edges.sparkSession)
    edges = keep.keep(edges.distinct(), drop_before=False)
    degree = out_degree(edges)
    shares = keep.keep(edges.join(degree, "src").select("src", "dst", (1.0 / F.col("degree")).alias("share")), drop_before=False)
    nodes = keep.keep(nodes_of(edges).join(degree.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("degree").isNull().alias("dangling")), drop_before=False)
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("page_rank"))
    ranks = keep.keep(nodes.select("id", "dangling", F.lit(1.0 / n).alias("page_rank")))
    for _ in range(rounds):
        lost = ranks.where("dangling").agg(F.coalesce(F.sum("page_rank"), F.lit(0.0))).first()[0]
        given = shares.join(ranks.select(F.col("id").alias("src"), "page_rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("page_rank") * F.col("share")).alias("given"))
        base = (1 - damping) / n + damping * lost / n
        new = ranks.join(given, "id", "left").select("id", "dangling", (F.lit(base) + damping * F.coalesce("given", F.lit(0.0))).alias("page_rank"), F.col("page_rank").alias("before"))
        ranks = keep.keep(new)
        moved = ranks.agg(F.max(F.abs(F.col("page_rank") - F.col("before")))).first()[0]
        ranks = ranks.select("id", "dangling", "page_rank")
        if moved <= eps:
            break
    return ranks.select("id", "page_rank")


def write_back(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """Documents with new ranks; those outside the graph keep theirs."""
    new = ranks.select(F.col("id").alias("doc_id"), F.col("page_rank").alias("_new"))
    return docs.join(new, "doc_id", "left").withColumn("page_rank", F.coalesce("_new", "page_rank")).drop("_new")
