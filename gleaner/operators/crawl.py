"""Crawl operators: frontier, duplicates, caps, links, robots, and the round loop.

The loop is breadth first. A round fetches at most HOST_CAP queued pages of a host and
PAGE_CAP in all, drops contents met before, takes those that host and crawl have
places for, and queues the links that are new after what it left of the queue.
Every round's documents, links and queue are saved under a commit of their own; a
crawl that finds commits in its folder goes on from them.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass
from http.client import HTTPException
from urllib.request import Request, urlopen
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import absolute_url, hrefs, normalize_url, url_host
from ..sources.html import page_title
from ..sources.scratch import Rounds
from ..sources.store import last_commit, load_documents, load_links, load_queue, save_crawl, save_queue

HOST_CAP, PAGE_CAP, QUEUE_CAP, LINK_CAP = 20, 2000, 10_000, 11


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """seq, url of a text file with one URL a line; order is kept within a file."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), F.trim("value").alias("url"))
    return rows.where(F.col("url").rlike("^https?://"))


def write_seeds(urls: DataFrame, path: str) -> None:
    urls.select("url").write.mode("append").text(path)


def frontier(seeds: DataFrame, visited: DataFrame | None = None, hosts: DataFrame | None = None, host_cap: int = HOST_CAP) -> DataFrame:
    """seq, url: seeds (seq, url) normalized, each once, none visited (url) and none
    of a host that is full already (host, n)."""
    rows = seeds.select("seq", normalize_url(F.col("url")).alias("url")).where("url IS NOT NULL")
    rows = rows.groupBy("url").agg(F.min("seq").alias("seq"))
    if visited is not None:
        rows = rows.join(visited.select("url").distinct(), "url", "left_anti")
    if hosts is not None:
        full = hosts.where(F.col("n") >= host_cap).select(F.col("host").alias("_host"))
        rows = rows.join(full, url_host(F.col("url")) == F.col("_host"), "left_anti")
    return rows.select("seq", "url")


def pages_per_host(urls: DataFrame, url: str = "url") -> DataFrame:
    return urls.groupBy(url_host(F.col(url)).alias("host")).agg(F.count("*").alias("n"))


def host_cap(rows: DataFrame, cap: int = HOST_CAP, order: str = "seq", url: str = "url", taken: DataFrame | None = None) -> DataFrame:
    """Of every host the first rows, up to cap with those taken before (host, n)."""
    rows = rows.withColumn("_host", url_host(F.col(url)))
    # no host can have more than cap: tasks leave out the rest before the shuffle
    rows = rows.withColumn("_k", F.row_number().over(W.partitionBy("_host").orderBy(order))).where(F.col("_k") <= cap)
    if taken is not None:
        rows = rows.join(taken.select(F.col("host").alias("_host"), F.col("n").alias("_had")), "_host", "left")
    else:
        rows = rows.withColumn("_had", F.lit(0))
    return rows.where(F.col("_k") <= cap - F.coalesce("_had", F.lit(0))).drop("_host", "_had", "_k")


def content_dedup(rows: DataFrame, content: str = "html", order: str = "doc_id", known: DataFrame | None = None) -> DataFrame:
    """Rows plus hash, the first of each content; none whose hash is known."""
    rows = rows.withColumn("hash", F.md5(F.coalesce(F.col(content), F.lit(""))))
    first = rows.groupBy("hash").agg(F.min(order).alias("_first"))
    if known is not None:
        first = first.join(known.select("hash").distinct(), "hash", "left_anti")
    first = first.withColumnRenamed("hash", "_hash")
    return rows.join(first, (F.col("hash") == F.col("_hash")) & (F.col(order) == F.col("_first")), "left_semi")


def link_extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", cap: int | None = None) -> DataFrame:
    """page, seq, link: the distinct absolute http links of each page in order of
    first occurrence, `cap` at most. All in the page's row; nothing is shuffled."""
    found = F.transform(hrefs(F.coalesce(F.col(html), F.lit(""))), lambda h: absolute_url(F.col(url), h))
    found = F.array_distinct(F.filter(found, lambda x: x.startswith("http")))
    if cap is not None:
        found = F.slice(found, 1, cap)
    return pages.select(F.col(key).alias("page"), F.posexplode(found).alias("seq", "link"))


def is_html(content_type: F.Column) -> F.Column:
    return F.coalesce(F.lower(content_type).startswith("text/html"), F.lit(False))


def allowed_by_robots(urls: DataFrame, rules: DataFrame, agent: str = "*", url: str = "url") -> DataFrame:
    """Rows whose url the robots rules (origin, robots_txt) of its origin allow; an
    origin without rules allows all."""
    rows = urls.withColumn("_origin", F.concat(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit("://"), url_host(F.col(url))))
    rows = rows.join(rules.select(F.col("origin").alias("_origin"), F.col("robots_txt").alias("_robots")), "_origin", "left")
    at, text = rows.columns.index(url), rows.columns.index("_robots")

    def run(it):
        parsers: dict = {}
        for b in it:
            keep = []
            for u, t in zip(b.column(at).to_pylist(), b.column(text).to_pylist(), strict=True):
                if t is None:
                    keep.append(True)
                    continue
                if t not in parsers:
                    parsers[t] = RobotFileParser()
                    parsers[t].parse(t.splitlines())
                keep.append(u is None or parsers[t].can_fetch(agent, u))
            yield b.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, rows.schema).drop("_origin", "_robots")


#: (url rows) -> the rows with html and content_type; failures are left out
Fetcher = Callable[[DataFrame], DataFrame]


def offline_fetcher(pages: DataFrame, url: str = "url", html: str = "html") -> Fetcher:
    """A fetcher that looks pages up in a table, by normalized url."""
    known = pages.select(normalize_url(F.col(url)).alias("url"), F.col(html).alias("html")).where("url IS NOT NULL").groupBy("url").agg(F.min("html").alias("html"))
    return lambda rows: rows.join(known, "url").withColumn("content_type", F.lit("text/html"))


AGENTS = ("Mozilla/5.0 (compatible; gleaner)", "Mozilla/5.0 (X11; Linux x86_64; gleaner)")
TIMEOUT = 5.0


def fetch_page(url: str, agent: str, timeout: float = TIMEOUT) -> tuple[str, str] | None:
    """(html, content type) of a page that answers 200 with HTML in time, or None."""
    try:
        with urlopen(Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
            kind = r.headers.get("Content-Type") or ""
            if r.status != 200 or not kind.lower().startswith("text/html"):
                return None
            return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), kind
    except (OSError, ValueError, HTTPException):
        return None


def http_fetcher(agents: tuple[str, ...] = AGENTS, timeout: float = TIMEOUT) -> Fetcher:
    """A fetcher that asks the web. One agent of those named is taken at random for each
    page; pages that fail are left out."""

    def fetch(rows: DataFrame) -> DataFrame:
        at = rows.columns.index("url")

        def run(it):
            for b in it:
                got = [fetch_page(u, random.choice(agents), timeout) for u in b.column(at).to_pylist()]
                some = b.filter(pa.array([g is not None for g in got], pa.bool_()))
                html, kind = ([g[k] for g in got if g] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(html, pa.string()), pa.array(kind, pa.string())], names=[*some.schema.names, "html", "content_type"])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("html", T.StringType()), T.StructField("content_type", T.StringType())]))

    return fetch


@dataclass
class Crawl:
    documents: DataFrame  # doc_id, url, title, html, hash
    links: DataFrame  # doc_id, link
    queue: DataFrame  # what is left to fetch: seq, url


def crawl(spark: SparkSession, seeds: DataFrame, fetch: Fetcher, robots: DataFrame | None = None, rounds: int | None = None, page_cap: int = PAGE_CAP, per_host: int = HOST_CAP, path: str | None = None) -> Crawl:
    """Rounds (all it takes by default) until the queue is empty or page_cap is
    reached. A page that fails or repeats a content is visited but holds no place of
    its host; what a round leaves of the queue stays there while its host has places.
    path: where rounds are saved. What is there counts: its documents are visited, its
    hosts and contents known, its queue comes before new seeds, and page_cap holds for
    all. Pages that failed are tried again by a later crawl."""
    keep = Rounds(spark)
    path = path or f"{keep.root}/crawl"
    kept = lambda df: keep.keep(df, drop_before=False)
    stored = lambda: load_documents(spark, path).select("doc_id", "url", "title", "html", "hash")
    commit, docs = last_commit(spark, path), stored()
    n_docs, last_id = docs.agg(F.count("*"), F.coalesce(F.max("doc_id"), F.lit(0))).first()
    visited, hosts, _ = resume(docs)
    queue, left = frontier(seeds, visited, hosts, per_host), load_queue(spark, path)
    if left is not None:
        left = frontier(left, visited, hosts, per_host)
        queue = left.union(queue.join(left, "url", "left_anti").select(F.col("seq") + 1 + (left.agg(F.max("seq")).first()[0] or 0), "url"))
    queue, failed, turn = kept(queue), None, 0
    while (rounds is None or turn < rounds) and n_docs < page_cap and not queue.isEmpty():
        turn, commit = turn + 1, commit + 1
        due = queue if robots is None else kept(allowed_by_robots(queue, robots))
        take = kept(host_cap(due, per_host).orderBy("seq").limit(page_cap))
        got = kept(fetch(take).where(is_html(F.col("content_type"))).select("seq", "url", "html"))
        new = host_cap(content_dedup(got, order="seq", known=docs), per_host, taken=pages_per_host(docs)).orderBy("seq").limit(page_cap - n_docs)
        # at most page_cap rows
        numbered = new.withColumn("doc_id", F.row_number().over(W.orderBy("seq")).cast("long") + last_id)
        new = kept(numbered.select("doc_id", "url", page_title(F.col("html")).alias("title"), "html", "hash"))
        found = kept(link_extract(new, "doc_id", cap=LINK_CAP).select(F.col("page").alias("doc_id"), "seq", "link"))
        save_crawl(new, found.select("doc_id", "link"), path, commit)
        docs = stored()
        n_new = new.count()
        n_docs, last_id = n_docs + n_new, last_id + n_new
        # a page without a place, and copies of it, are as good as not fetched
        back = got.select("url", F.md5(F.coalesce("html", F.lit(""))).alias("hash")).join(docs.select("hash"), "hash", "left_anti")
        seen = take.select("url").join(back.select("url"), "url", "left_anti")
        failed = kept(seen if failed is None else failed.union(seen).distinct())
        visited, hosts = failed.union(docs.select("url")), pages_per_host(docs)
        rest = kept(frontier(due, visited, hosts, per_host))
        base = (queue.agg(F.max("seq")).first()[0] or 0) + 1  # links come after the queue so far
        order = (F.lit(base) + F.col("doc_id") * 1000 + F.col("seq")).alias("seq")
        more = frontier(found.select(order, F.col("link").alias("url")), visited.union(rest.select("url")), hosts, per_host)
        queue = kept(rest.union(more.orderBy("seq").limit(max(0, QUEUE_CAP - rest.count()))))
        save_queue(queue, path, commit)
    return Crawl(docs, load_links(spark, path).select("doc_id", "link"), queue)


def resume(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of stored documents: visited (url), pages per host (host, n), hashes (hash)."""
    return docs.select("url"), pages_per_host(docs), docs.select("hash").distinct()
