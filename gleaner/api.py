"""search() and suggest(): what a user calls."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.snippets import clean_html, snippet
from .operators.index import Index
from .operators.match import match, match_count
from .operators.ranking import PAGE_SIZE, page_args, page_of, scores
from .operators.suggest import suggest_popular, suggest_terms
from .plans.query import parse, query_words


@dataclass
class Response:
    results: DataFrame  # rank, doc_id, url, title, score, snippet
    total: int

    def json(self) -> str:
        rows = [r.asDict() for r in self.results.orderBy("rank").collect()]
        return json.dumps({"results": rows, "totalCount": self.total}, ensure_ascii=False)


def search(spark: SparkSession, index: Index, docs: DataFrame, query: str, page: int = 0, size: int = PAGE_SIZE, page_rank: DataFrame | None = None, drop_stop_words: bool = False) -> Response:
    """docs: doc_id, url, title, html. Texts are read for the page's rows only."""
    if not (query or "").strip():
        raise ValueError("blank query")
    page_args(page, size)
    tree = parse(query, index.stemmed, drop_stop_words)
    found = match(index, tree)
    words = query_words(tree)
    top = page_of(scores(found, words, page_rank), page, size)
    shown = top.join(docs.select("doc_id", "url", "title", "html"), "doc_id")
    shown = shown.withColumn("_text", clean_html(F.col("html")))
    text = snippet(F.col("_text"), list(dict.fromkeys(t.word.strip('"') for t in words)))
    return Response(shown.select("rank", "doc_id", "url", "title", "score", text.alias("snippet")), match_count(found).first()[0])


def suggest(index: Index, prefix: str) -> list[str]:
    return [r.word for r in suggest_terms(index.vocab, prefix).orderBy("rank").collect()]


def suggest_from_log(log: DataFrame, prefix: str) -> list[str]:
    """log: query, count."""
    words = log.select(F.col("query").alias("word"), F.col("count").alias("freq"))
    return [r.word for r in suggest_popular(words, prefix).orderBy("rank").collect()]
