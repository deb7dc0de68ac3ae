"""The engine's queries over the driver's tables, each with its DuckDB counterpart.

Ordered results carry a rank; doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import api
from . import oracle_sql as O
from .functions import porter
from .functions.snippets import clean_html, highlight
from .functions.text import RUN, STOP_WORDS, read_stop_words, runs, tokens
from .functions.urls import filter_params, normalize_url, url_host
from .operators import crawl as C
from .operators import pagerank as P
from .operators import suggest as S
from .operators.index import Index, blocks_of, build_index, merge_index, occurrences
from .operators.match import match, match_count, phrase_docs
from .operators.ranking import page_of, scores
from .plans.query import parse, query_words
from .sources.html import html_blocks, page_title
from .sources.scratch import Rounds
from .sources.store import load_documents, table, with_ids
from .streaming.ingest import keep_latest, read_stream, window_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---- shared SQL ------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
_RUN = RUN.replace("'", "''")
_VALID = f"length(x) BETWEEN 2 AND 45 AND regexp_matches(x, '^[a-zA-Z]+$') AND x NOT IN ({_STOP})"


def _tokens(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(lower({text}), '{_RUN}'), lambda r: trim(r, '''')), lambda x: {_VALID})"


#: blocks, their words, occurrences, postings and vocabulary of `documents`
_INDEX = f"""
blocks AS (SELECT doc_id, 0 AS seq, 5.0 AS weight, split_part(coalesce(text, ''), chr(10), 1) AS t FROM documents
 UNION ALL SELECT doc_id, 1, 1.0, substr(text, length(split_part(text, chr(10), 1)) + 2) FROM documents),
read AS (SELECT doc_id, weight, {_tokens("t")} AS words FROM blocks),
totals AS (SELECT doc_id, sum(len(words)) AS total FROM read GROUP BY doc_id),
found AS (SELECT doc_id, weight, unnest(words) AS word, unnest(generate_series(0, len(words) - 1)) AS position FROM read WHERE len(words) > 0),
postings AS (SELECT f.word, f.doc_id, sum(f.weight) / any_value(t.total) AS tf, max(f.weight) AS importance, list_sort(list_distinct(list(f.position))) AS positions
 FROM found f JOIN totals t USING (doc_id) GROUP BY f.word, f.doc_id),
n AS (SELECT count(*) AS n FROM documents),
vocab AS (SELECT word, count(DISTINCT doc_id) AS df, log10(any_value(n.n) / count(DISTINCT doc_id)) + 0.0 AS idf FROM postings, n GROUP BY word)"""


_EDGES = "edges AS (SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)"


def _rank_ctes(rounds: int) -> str:
    return f"""{_EDGES}, nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), nn AS (SELECT count(*) AS n FROM nodes),
deg AS (SELECT src, count(*) AS d FROM edges GROUP BY src),
r(i, id, pr) AS (SELECT 0, id, 1.0::DOUBLE / n FROM nodes, nn UNION ALL
 SELECT any_value(p.i) + 1, v.id, any_value(0.15::DOUBLE / nn.n + 0.85::DOUBLE * p.lost / nn.n) + 0.85::DOUBLE * coalesce(sum(CASE WHEN e.dst IS NOT NULL THEN p.pr / g.d END), 0)
 FROM nodes v CROSS JOIN nn CROSS JOIN (SELECT i, id, pr, sum(CASE WHEN id NOT IN (SELECT src FROM deg) THEN pr ELSE 0 END) OVER () AS lost FROM r WHERE i < {rounds}) p
 LEFT JOIN deg g ON g.src = p.id LEFT JOIN edges e ON e.src = p.id AND e.dst = v.id GROUP BY v.id),
ranks AS (SELECT id, round(pr, 7) AS page_rank FROM r WHERE i = {rounds})"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _index(spark: SparkSession, sf_dir: str, stem: bool = False, whole: bool = False):
    return build_index(blocks_of(_docs(spark, sf_dir)), stem=stem, whole=whole)


# ---- words and index ---------------------------------------------------------------


@query("token_stats", f"""SELECT doc_id, CAST(len(r) AS BIGINT) AS n_runs, CAST(len(list_distinct(r)) AS BIGINT) AS n_distinct, CAST(coalesce(list_sum(list_transform(r, lambda x: length(x))), 0) AS BIGINT) AS n_chars
 FROM (SELECT doc_id, list_transform(regexp_extract_all(lower(coalesce(text, '')), '{_RUN}'), lambda r: trim(r, '''')) AS r
 FROM documents)""")
def token_stats(spark, sf_dir):
    r = runs(F.coalesce("text", F.lit("")))
    chars = F.aggregate("r", F.lit(0).cast("long"), lambda a, w: a + F.length(w))
    return _docs(spark, sf_dir).select("doc_id", r.alias("r")).select("doc_id", F.size("r").cast("long").alias("n_runs"), F.size(F.array_distinct("r")).cast("long").alias("n_distinct"), chars.alias("n_chars"))


@query("token_valid", f"""SELECT doc_id, CAST(len(w) AS BIGINT) AS n_valid, CAST(len(list_distinct(w)) AS BIGINT) AS n_words
 FROM (SELECT doc_id, {_tokens("coalesce(text, '')")} AS w
 FROM documents)""")
def token_valid(spark, sf_dir):
    w = _docs(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_valid"), F.size(F.array_distinct("w")).cast("long").alias("n_words"))


@query("stop_word_file", f"""WITH listed AS (SELECT DISTINCT lower(trim(event_type)) AS w FROM events UNION SELECT 'anea' UNION SELECT 'tion'),
r AS (SELECT doc_id, list_transform(regexp_extract_all(lower(coalesce(text, '')), '{_RUN}'), lambda r: trim(r, '''')) AS r FROM documents),
a AS (SELECT list(w) AS stop FROM listed)
SELECT doc_id, CAST(len(list_filter(r, lambda x: length(x) BETWEEN 2 AND 45 AND regexp_matches(x, '^[a-zA-Z]+$')
 AND NOT list_contains(stop, x))) AS BIGINT) AS n FROM r, a""")
def stop_word_file(spark, sf_dir):
    """Words counted without those of a stop word file."""
    at = f"{Rounds(spark).root}/stop"
    own = spark.createDataFrame([("  ANEA ",), ("",), ("tion",)], "value string")
    own.union(table(spark, sf_dir, "events").select("event_type").distinct()).write.text(at)
    return _docs(spark, sf_dir).select("doc_id", F.size(tokens(F.col("text"), read_stop_words(spark, at))).cast("long").alias("n"))


@query("block_tokens", f"WITH {_INDEX} SELECT doc_id, CAST(total AS BIGINT) AS total FROM totals")
def block_tokens(spark, sf_dir):
    """Counted tokens of each document."""
    b = blocks_of(_docs(spark, sf_dir))
    return b.select("doc_id", F.aggregate("blocks", F.lit(0).cast("long"), lambda a, x: a + F.size(tokens(x["text"]))).alias("total"))


@query("weighted_tf", f"WITH {_INDEX} SELECT doc_id, word, round(tf, 9) AS tf FROM postings")
def weighted_tf(spark, sf_dir):
    return _index(spark, sf_dir, whole=True).postings.select("doc_id", "word", F.round("tf", 9).alias("tf"))


@query("word_importance", f"WITH {_INDEX} SELECT doc_id, word, CAST(importance AS DOUBLE) AS importance FROM postings")
def word_importance(spark, sf_dir):
    return _index(spark, sf_dir, whole=True).postings.select("doc_id", "word", "importance")


@query("word_positions", f"""WITH {_INDEX} SELECT doc_id, word, CAST(len(positions) AS BIGINT) AS n, CAST(positions[1] AS INTEGER) AS first, CAST(positions[-1] AS INTEGER) AS last, CAST(list_sum(positions) AS BIGINT) AS total
 FROM postings""")
def word_positions(spark, sf_dir):
    p = _index(spark, sf_dir, whole=True).postings
    total = F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x)
    return p.select("doc_id", "word", F.size("positions").cast("long").alias("n"), F.element_at("positions", 1).alias("first"), F.element_at("positions", -1).alias("last"), total.alias("total"))


@query("doc_freq_idf", f"WITH {_INDEX} SELECT word, df, round(idf, 9) AS idf FROM vocab")
def doc_freq_idf(spark, sf_dir):
    return _index(spark, sf_dir, whole=True).vocab.select("word", "df", F.round("idf", 9).alias("idf"))


@query("corpus_size", "SELECT count(*) AS n_docs FROM documents")
def corpus_size(spark, sf_dir):
    return _docs(spark, sf_dir).agg(F.count("*").alias("n_docs"))


@query("porter_stem", f"WITH {_INDEX}, words AS (SELECT DISTINCT word FROM found), {O.porter('words')} SELECT word, stem FROM stemmed")
def porter_stem(spark, sf_dir):
    return porter.stems(occurrences(blocks_of(_docs(spark, sf_dir))).select("word").distinct())


def _by_stem(found: str, key: str = "doc_id") -> str:
    """CTEs from occurrences (key, word, weight) to `by_stem` (word, key, tf, importance)."""
    return f"""vocabulary AS (SELECT DISTINCT word FROM {found}), {O.porter("vocabulary")},
so AS (SELECT f.{key}, f.weight, s.stem AS x FROM {found} f JOIN stemmed s USING (word)),
st AS (SELECT {key}, count(*) FILTER ({_VALID}) AS total FROM so GROUP BY {key}),
by_stem AS (SELECT x AS word, so.{key}, max(weight) AS importance,
 round(CASE WHEN any_value(total) > 0 THEN sum(weight) / any_value(total) ELSE sum(weight) END, 9) AS tf
 FROM so JOIN st USING ({key}) GROUP BY x, so.{key})"""


@query("stemmed_tf", f"WITH {_INDEX}, {_by_stem('found')} SELECT word, doc_id, tf FROM by_stem")
def stemmed_tf(spark, sf_dir):
    """Postings by stem; tokens whose stem is a stop word don't count in the total."""
    return _index(spark, sf_dir, stem=True, whole=True).postings.select("word", "doc_id", F.round("tf", 9).alias("tf"))


@query("stem_text", O.STEM_TEXT)
def stem_text(spark, sf_dir):
    """Whole texts with every run of letters stemmed."""
    return porter.stem_texts(_docs(spark, sf_dir).select("doc_id", F.col("text").alias("value")))


@query("index_merge", f"WITH {_INDEX} SELECT doc_id, count(*) AS n_words, round(sum(tf), 9) AS tf FROM postings GROUP BY doc_id")
def index_merge(spark, sf_dir):
    """Documents of even id indexed again over an index of all: nothing twice."""
    docs = _docs(spark, sf_dir)
    old, new = build_index(blocks_of(docs)).postings, build_index(blocks_of(docs.where("doc_id % 2 = 0")), n_docs=1).postings
    return merge_index(old, new).groupBy("doc_id").agg(F.count("*").alias("n_words"), F.round(F.sum("tf"), 9).alias("tf"))


# ---- search ----------------------------------------------------------------------------


def _matched(keys: list[str]) -> str:
    names = ", ".join(f"'{k}'" for k in keys)
    return f"SELECT p.doc_id, p.word AS term, p.tf, v.idf FROM postings p JOIN vocab v USING (word) WHERE p.word IN ({names})"


def _ranked(matches: str, words: list[str], page: int = 0, size: int = 10) -> str:
    times = " ".join(f"WHEN term = '{w}' THEN {words.count(w)}" for w in dict.fromkeys(words))
    return f"""WITH {_INDEX}, m AS ({matches}),
s AS (SELECT doc_id, round(0.7 * sum(tf * idf * (CASE {times} ELSE 0 END)), 9) AS score FROM m GROUP BY doc_id)
SELECT * FROM (SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s) WHERE rank > {page * size} AND rank <= {(page + 1) * size}"""


def _search(text: str, page: int = 0, size: int = 10) -> Query:
    def run(spark, sf_dir):
        tree = parse(text)
        return page_of(scores(match(_index(spark, sf_dir), tree), query_words(tree)), page, size)

    return run


_L, _R = ["anea", "eriner"], ["thth", "edon"]
_SEMI = lambda side: f"doc_id IN (SELECT doc_id FROM ({_matched(side)}))"
query("search_word", _ranked(_matched(_L), _L))(_search("anea eriner"))


@query("search_stored", _ranked(_matched(_L), _L))
def search_stored(spark, sf_dir):
    """The same from an index that was written and read again."""
    at, tree = f"{Rounds(spark).root}/index", parse("anea eriner")
    _index(spark, sf_dir, whole=True).write(at)
    return page_of(scores(match(Index.read(spark, at), tree), query_words(tree)))


query("search_one_word", _ranked(_matched(["thth"]), ["thth"], 0, 100))(_search("thth", 0, 100))
query("search_page2", _ranked(_matched(_L), _L, 1))(_search("anea eriner", 1))
query("search_past_end", _ranked(_matched(_L), _L, 100000))(_search("anea eriner", 100000))
query("search_and", _ranked(f"SELECT * FROM ({_matched(_L)}) WHERE {_SEMI(_R)}", _L + _R))(_search("anea eriner AND thth edon"))
query("search_not", _ranked(f"SELECT * FROM ({_matched(_L)}) WHERE NOT {_SEMI(_R)}", _L + _R))(_search("anea eriner NOT thth edon"))
query("search_or", _ranked(f"SELECT DISTINCT * FROM ({_matched(_L)} UNION ALL {_matched(['eriner', *_R])})", [*_L, "eriner", *_R]))(_search("anea eriner OR eriner thth edon"))

_FOLD = "list_reduce(list_prepend(CAST(s * 2 AS BIGINT), list_transform(p{k}, lambda z: CAST(z AS BIGINT))), lambda a, p: CASE WHEN p > a // 2 AND p <= a // 2 + 3 AND (a % 2 = 0 OR p < a // 2 + 3) THEN p * 2 + 1 ELSE a END)"


def _phrase(keys: list[str]) -> str:
    """Documents that hold a phrase. A start is followed list by list; -1 is a start lost."""
    names = ", ".join(f"'{k}'" for k in keys)
    places = ", ".join(f"any_value(positions) FILTER (word = '{k}') AS p{i}" for i, k in enumerate(keys))
    starts = "p0"
    for i in range(1, len(keys)):
        walk = _FOLD.format(k=i)
        starts = f"list_filter(list_transform({starts}, lambda s: CASE WHEN {walk} % 2 = 1 THEN {walk} // 2 ELSE -1 END), lambda s: s >= 0)"
    return f"""SELECT doc_id FROM (SELECT doc_id, {places} FROM postings WHERE word IN ({names}) GROUP BY doc_id HAVING count(DISTINCT word) = {len(keys)})
WHERE len({starts}) > 0"""


@query("phrase_exact_gap", f"WITH {_INDEX} {_phrase(['anea', 'eriner'])}")
def phrase_exact_gap(spark, sf_dir):
    return phrase_docs(_index(spark, sf_dir), parse('"anea eriner"').terms)


@query("phrase_three_words", f"WITH {_INDEX} {_phrase(['anea', 'eriner', 'thanea'])}")
def phrase_three_words(spark, sf_dir):
    return phrase_docs(_index(spark, sf_dir), parse('"anea eriner thanea"').terms)


query("search_phrase", _ranked(f"SELECT * FROM ({_matched(_L)}) WHERE doc_id IN ({_phrase(_L)})", _L))(_search('"anea eriner"'))
query("search_phrase_and", _ranked(f"SELECT * FROM ({_matched(_L)}) WHERE doc_id IN ({_phrase(_L)}) AND {_SEMI(['thth'])}", [*_L, "thth"]))(_search('"anea eriner" AND thth'))


@query("match_count", f"WITH {_INDEX} SELECT count(DISTINCT doc_id) AS n_docs FROM ({_matched(_L)})")
def match_count_(spark, sf_dir):
    return match_count(match(_index(spark, sf_dir), parse("anea eriner")))


@query("search_snippets", _ranked(_matched(_L), _L).replace("\nSELECT * FROM (SELECT row_number()", ",\ntop AS (SELECT * FROM (SELECT row_number()") + f"""),
texts AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, {O.clean("text")} AS t FROM documents WHERE doc_id IN (SELECT doc_id FROM top)),
{O.snippets("texts", _L)}
SELECT rank, doc_id, '' AS url, title, score, snippet FROM top JOIN texts USING (doc_id) JOIN snippets USING (doc_id)""")
def search_snippets(spark, sf_dir):
    """A page of results as a user gets it."""
    docs = _docs(spark, sf_dir).select("doc_id", F.lit("").alias("url"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("html"))
    return api.search(spark, _index(spark, sf_dir), docs, "anea eriner").results


@query("rank_with_pagerank", f"""WITH RECURSIVE {_INDEX}, {_rank_ctes(4)}, m AS ({_matched(_L)}),
s AS (SELECT doc_id, round(0.7 * sum(tf * idf) + 0.3 * coalesce(any_value(page_rank), 0), 9) AS score FROM m LEFT JOIN ranks ON ranks.id = m.doc_id GROUP BY doc_id)
SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s ORDER BY rank LIMIT 10""")
def rank_with_pagerank(spark, sf_dir):
    """Scores that mix in page ranks of a graph over document ids."""
    ranks = _ranks(spark, sf_dir, 4).withColumnRenamed("id", "doc_id")
    tree = parse("anea eriner")
    return page_of(scores(match(_index(spark, sf_dir), tree), query_words(tree), ranks), 0, 10)


# ---- urls, crawl -------------------------------------------------------------------------

_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_QUERY = "regexp_extract(url, '\\?([^#]*)', 1)"
_KEPT = f"array_to_string(list_filter(string_split({_QUERY}, '&'), lambda k: lower(split_part(k, '=', 1)) IN ('q', 'search', 'id', 'page', 'sort', 'category')), '&')"
_PATH = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_NORM = f"lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) || '://' || {_HOST} || CASE WHEN regexp_replace({_PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_PATH}, '/+$', '') END || CASE WHEN {_KEPT} = '' THEN '' ELSE '?' || {_KEPT} END"


@query("url_host", f"SELECT page_id, {_HOST} AS host FROM pages")
def url_host_(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", url_host(F.col("url")).alias("host"))


@query("url_query_filter", f"SELECT page_id, {_KEPT} AS kept FROM pages")
def url_query_filter(spark, sf_dir):
    q = F.coalesce(F.try_parse_url("url", F.lit("QUERY")), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", filter_params(q).alias("kept"))


@query("url_normalize", f"SELECT page_id, {_NORM} AS url FROM pages")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", normalize_url(F.col("url")).alias("url"))


@query("content_hash_dedup", "SELECT min(doc_id) AS doc_id, md5(coalesce(text, '')) AS hash FROM documents GROUP BY 2")
def content_hash_dedup(spark, sf_dir):
    return C.content_dedup(_docs(spark, sf_dir).select("doc_id", "text"), content="text").select("doc_id", "hash")


@query("pages_per_host", f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1")
def pages_per_host(spark, sf_dir):
    return C.pages_per_host(table(spark, sf_dir, "pages"))


@query("host_cap", f"""SELECT page_id, host
 FROM (SELECT page_id, {_HOST} AS host, row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) AS k
 FROM pages)
 WHERE k <= 20""")
def host_cap(spark, sf_dir):
    rows = C.host_cap(table(spark, sf_dir, "pages").select("page_id", "url"), order="page_id")
    return rows.select("page_id", url_host(F.col("url")).alias("host"))


@query("crawl_frontier", f"SELECT url, min(page_id) AS seq FROM (SELECT page_id, {_NORM} AS url FROM pages WHERE url LIKE 'http%') GROUP BY url")
def crawl_frontier(spark, sf_dir):
    return C.frontier(table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), "url").where("url LIKE 'http%'"))


@query("seed_file", f"""SELECT {_NORM} AS url
 FROM pages WHERE url LIKE 'http%' AND page_id % 2 = 0 GROUP BY 1""")
def seed_file(spark, sf_dir):
    """Urls written as a seed file, read again and normalized; other schemes are skipped."""
    pages, at = table(spark, sf_dir, "pages").where("page_id % 2 = 0"), f"{Rounds(spark).root}/seeds"
    other = pages.select(F.regexp_replace("url", "^http", "ftp").alias("url"))
    C.write_seeds(pages.select("url").union(other), at)
    return C.frontier(C.read_seeds(spark, at)).select("url")


@query("frontier_unvisited", f"""SELECT url, min(page_id) AS seq
 FROM (SELECT page_id, {_NORM} AS url, {_HOST} AS host
 FROM pages)
 WHERE url NOT IN (SELECT {_NORM}
 FROM pages
 WHERE page_id % 3 = 0) AND host NOT IN (SELECT {_HOST}
 FROM pages
 WHERE page_id % 3 = 0
 GROUP BY 1 HAVING count(*) >= 5)
 GROUP BY url""")
def frontier_unvisited(spark, sf_dir):
    """Every third page was visited; a host is full at five."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), "url")
    old = pages.where("seq % 3 = 0").select(normalize_url(F.col("url")).alias("url"))
    visited, hosts, _ = C.resume(old.withColumn("hash", F.md5("url")))
    return C.frontier(pages, visited, hosts, host_cap=5)


_LINKS = """h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href, generate_subscripts(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1), 1) AS i FROM pages),
l AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*', 0) || replace(href, '&amp;', '&') AS link, min(i) AS i FROM h WHERE href LIKE '/%' GROUP BY 1, 2),
k AS (SELECT page_id AS page, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS seq, link FROM l)"""


@query("link_extract", f"WITH {_LINKS} SELECT * FROM k")
def link_extract(spark, sf_dir):
    return C.link_extract(table(spark, sf_dir, "pages"))


@query("link_cap", f"WITH {_LINKS} SELECT * FROM k WHERE seq < 3")
def link_cap(spark, sf_dir):
    """A cap of three, as no page here has more than eleven links."""
    return C.link_extract(table(spark, sf_dir, "pages"), cap=3)


@query("page_title", """SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title
 FROM pages""")
def page_title_(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", page_title(F.col("html")).alias("title"))


@query("robots_filter", "SELECT page_id FROM pages WHERE NOT regexp_matches(url, '^[a-zA-Z]+://[^/?#]*/fr/')")
def robots_filter(spark, sf_dir):
    """Every origin forbids its French pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    origin = F.concat(F.lower(F.try_parse_url("url", F.lit("PROTOCOL"))), F.lit("://"), url_host(F.col("url")))
    rules = pages.select(origin.alias("origin")).distinct().withColumn("robots_txt", F.lit("User-agent: *\nDisallow: /fr/\n"))
    return C.allowed_by_robots(pages, rules).select("page_id")


@query("document_ids", f"""SELECT page_id, url, CAST(dense_rank() OVER (ORDER BY url) AS BIGINT) AS doc_id
 FROM (SELECT page_id, {_NORM} AS url
 FROM pages)""")
def document_ids(spark, sf_dir):
    """Ids of urls, all new."""
    rows = table(spark, sf_dir, "pages").select("page_id", normalize_url(F.col("url")).alias("url"))
    return with_ids(rows, spark.createDataFrame([], "doc_id long, url string")).select("page_id", "url", "doc_id")


@query("crawl", f"""WITH u AS (SELECT {_NORM} AS url, min(page_id) AS seq, arg_min(html, html) AS html FROM pages GROUP BY 1),
h AS (SELECT *, md5(html) AS hash, row_number() OVER (PARTITION BY md5(html) ORDER BY seq) AS again FROM u),
c AS (SELECT *, row_number() OVER (PARTITION BY split_part(split_part(url, '://', 2), '/', 1) ORDER BY seq) AS place FROM h WHERE again = 1)
SELECT CAST(row_number() OVER (ORDER BY seq) AS BIGINT) AS doc_id, url, hash,
 trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title
FROM c WHERE place <= 20 ORDER BY seq LIMIT 2000""")
def crawl(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    seeds = pages.select(F.col("page_id").alias("seq"), "url")
    return C.crawl(spark, seeds, C.offline_fetcher(pages)).documents.select("doc_id", "url", "title", "hash")


@query("crawl_resumed", f"""WITH u AS (SELECT {_NORM} AS url, min(page_id) AS seq, any_value(html) AS html FROM pages GROUP BY 1),
c AS (SELECT *, row_number() OVER (PARTITION BY split_part(split_part(url, '://', 2), '/', 1) ORDER BY seq) AS place FROM u),
k AS (SELECT *, row_number() OVER (ORDER BY seq) AS doc_id FROM c WHERE place <= 3)
SELECT CAST(doc_id AS BIGINT) AS doc_id, url, md5(html) AS hash FROM k WHERE doc_id <= 30""")
def crawl_resumed(spark, sf_dir):
    """A crawl of at most three pages a host and thirty in all, stopped at a cap of ten
    and taken up again from what was saved."""
    pages, at = table(spark, sf_dir, "pages"), f"{Rounds(spark).root}/crawl"
    seeds = pages.select(F.col("page_id").alias("seq"), "url")
    for cap in (10, 30):
        C.crawl(spark, seeds, C.offline_fetcher(pages), page_cap=cap, per_host=3, path=at)
    return load_documents(spark, at).select("doc_id", "url", "hash")


# ---- link graph, page rank -----------------------------------------------------------------



def _transitions(spark, sf_dir) -> DataFrame:
    """Edges from each event's user to the next event's. The order is global, so
    rows are numbered by range partitions, and joined with the next number."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    day = F.date_trunc("day", "ts")
    w = W.partitionBy(day).orderBy("ts", "event_id")
    inside = rows.select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst")).where("dst IS NOT NULL")
    ends = rows.groupBy(day.alias("day")).agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"), F.max_by("user_id", F.struct("ts", "event_id")).alias("last"))
    across = ends.select(F.col("last").alias("src"), F.lead("first").over(W.orderBy("day")).alias("dst")).where("dst IS NOT NULL")  # a row a day
    return inside.union(across).distinct()


def _ranks(spark, sf_dir, rounds: int) -> DataFrame:
    return P.pagerank(_transitions(spark, sf_dir), eps=0.0, rounds=rounds).select("id", F.round("page_rank", 7).alias("page_rank"))


@query("link_graph", """WITH s AS (SELECT page_id, url
 FROM pages), l AS (SELECT a.page_id AS doc_id, b.url AS link
 FROM s a
 JOIN s b ON b.page_id = a.page_id + 1) SELECT DISTINCT l.doc_id AS src, s.page_id AS dst
 FROM l
 JOIN s ON s.url = l.link""")
def link_graph(spark, sf_dir):
    """Each page links to the one after it; links resolve by url."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    links = pages.select((F.col("doc_id") - 1).alias("doc_id"), F.col("url").alias("link")).where("doc_id >= 0")
    return P.link_graph(links.join(pages.select("doc_id"), "doc_id", "left_semi"), pages)


@query("link_graph_normalized", f"""WITH s AS (SELECT page_id, url, {_NORM} AS norm FROM pages)
SELECT DISTINCT a.page_id - 1 AS src, b.page_id AS dst FROM s a JOIN s b ON a.norm = b.norm WHERE a.page_id - 1 IN (SELECT page_id FROM s)""")
def link_graph_normalized(spark, sf_dir):
    """Links that differ from urls by port, fragment and case find them once both are normalized."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    loud = F.concat(F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "#.*", ""), "^https", "HTTPS"), "^http:", "HTTP:"), F.lit("#end"))
    links = pages.select((F.col("doc_id") - 1).alias("doc_id"), loud.alias("link"))
    return P.link_graph(links.join(pages.select("doc_id"), "doc_id", "left_semi"), pages, normalize=True)


@query("transition_graph", f"WITH {_EDGES} SELECT src, dst FROM edges")
def transition_graph(spark, sf_dir):
    return _transitions(spark, sf_dir)


@query("out_degree", f"WITH {_EDGES} SELECT src, count(DISTINCT dst) AS degree FROM edges GROUP BY src")
def out_degree(spark, sf_dir):
    return P.out_degree(_transitions(spark, sf_dir))


@query("dangling_nodes", f"""WITH {_EDGES} SELECT DISTINCT dst AS id
 FROM edges
 WHERE dst NOT IN (SELECT src
 FROM edges) AND dst % 7 <> 0
 UNION SELECT DISTINCT dst
 FROM edges
 WHERE dst % 7 = 0""")
def dangling_nodes(spark, sf_dir):
    """With the edges out of every seventh user left out."""
    return P.dangling(_transitions(spark, sf_dir).where("src % 7 <> 0"))


@query("pagerank", f"WITH RECURSIVE {_rank_ctes(8)} SELECT id, page_rank FROM ranks")
def pagerank(spark, sf_dir):
    """Eight rounds (the default is to go on until ranks settle)."""
    return _ranks(spark, sf_dir, 8)


@query("pagerank_settled", f"""WITH RECURSIVE {_rank_ctes(40)},
far AS (SELECT i, r.id, pr, lag(pr) OVER (PARTITION BY r.id ORDER BY i) AS before FROM r),
moved AS (SELECT i, max(abs(pr - before)) AS most FROM far WHERE i > 0 GROUP BY i),
done AS (SELECT min(i) AS i FROM moved WHERE most <= 0.00001)
SELECT id, round(pr, 7) AS page_rank FROM r JOIN done USING (i)""")
def pagerank_settled(spark, sf_dir):
    """Until no rank moves by more than the default."""
    return P.pagerank(_transitions(spark, sf_dir)).select("id", F.round("page_rank", 7).alias("page_rank"))


@query("rank_write_back", f"""WITH RECURSIVE {_rank_ctes(4)} SELECT doc_id, coalesce(page_rank, 0.5) AS page_rank
 FROM documents LEFT
 JOIN ranks ON id = doc_id""")
def rank_write_back(spark, sf_dir):
    """Ranks written to documents; those outside the graph keep what they had."""
    docs = _docs(spark, sf_dir).select("doc_id", F.lit(0.5).alias("page_rank"))
    return P.write_back(docs, _ranks(spark, sf_dir, 4))


# ---- suggestions, query log --------------------------------------------------------------------


@query("suggest_terms", f"""WITH {_INDEX} SELECT row_number() OVER (ORDER BY CASE WHEN word = 'the' THEN 1 WHEN word = 'th' THEN 1 ELSE 3 END, word) AS rank, word
 FROM (SELECT DISTINCT word
 FROM vocab
 WHERE starts_with(word, 'th')) ORDER BY rank LIMIT 5""")
def suggest_terms(spark, sf_dir):
    return S.suggest_terms(_index(spark, sf_dir).vocab, "th")


@query("trie_topk", f"""WITH {_INDEX}, p AS (SELECT substr(word, 1, k) AS prefix, word, df
 FROM vocab, generate_series(1, 45) g(k)
 WHERE k <= length(word)) SELECT prefix, rank, word, df AS freq
 FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY df DESC, word) AS rank
 FROM p)
 WHERE rank <= 10""")
def trie_topk(spark, sf_dir):
    return S.prefix_table(_index(spark, sf_dir, whole=True).vocab.select("word", F.col("df").alias("freq")))


@query("suggest_popular", """SELECT row_number() OVER (ORDER BY freq DESC, word) AS rank, word, freq
 FROM (SELECT event_type AS word, count(*) AS freq
 FROM events
 WHERE starts_with(event_type, 'c')
 GROUP BY 1) ORDER BY rank LIMIT 10""")
def suggest_popular(spark, sf_dir):
    words = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("word")).agg(F.count("*").alias("freq"))
    return S.suggest_popular(words, "c")


_LOG = "log AS (SELECT event_type || '-' || CAST(user_id AS VARCHAR) AS query, count(*) AS count, max(ts) AS last_added FROM events GROUP BY 1), now AS (SELECT max(ts) AS now FROM events)"


@query("recent_queries", f"WITH {_LOG} SELECT query, count FROM log, now WHERE floor(epoch(now - last_added) / 3600) <= 12")
def recent_queries(spark, sf_dir):
    """Ages are taken at the time of the last event."""
    events = table(spark, sf_dir, "events")
    log = events.groupBy(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("query")).agg(F.count("*").alias("count"), F.max("ts").alias("last_added"))
    now = events.agg(F.max("ts")).first()[0]
    return S.recent_queries(log, now)


# ---- html, snippets ---------------------------------------------------------------------------


@query("html_blocks", f"WITH {O.HTML_BLOCKS} SELECT * FROM html_blocks")
def html_blocks_(spark, sf_dir):
    rows = html_blocks(table(spark, sf_dir, "pages"))
    return rows.select("doc_id", F.posexplode("blocks").alias("seq", "block")).select("doc_id", "seq", "block.tag", "block.text")


@query("html_headings", """SELECT page_id AS doc_id, replace(replace(replace(trim(regexp_replace(regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1), '\\s+', ' ', 'g')), '&quot;', '\"'), '&amp;', '&'), chr(160), ' ') AS text
 FROM pages""")
def html_headings(spark, sf_dir):
    rows = html_blocks(table(spark, sf_dir, "pages"))
    return rows.select("doc_id", F.explode("blocks").alias("b")).where("b.tag = 'h1'").select("doc_id", "b.text")


@query("page_index", f"""WITH {O.HTML_BLOCKS},
weights(tag, w) AS (VALUES ('title', 5.0), ('h1', 4.0), ('h2', 3.0), ('h3', 2.5), ('h4', 2.0), ('h5', 1.8), ('h6', 1.5)),
words AS (SELECT doc_id, coalesce(w, 1.0) AS weight, {_tokens("text")} AS x FROM html_blocks LEFT JOIN weights USING (tag)),
occurrences AS (SELECT doc_id, weight, unnest(x) AS word FROM words),
{_by_stem("occurrences")}
SELECT word, doc_id, tf, CAST(importance AS DOUBLE) AS importance FROM by_stem""")
def page_index(spark, sf_dir):
    """Weighted postings of html pages, stemmed."""
    pages = table(spark, sf_dir, "pages")
    return build_index(html_blocks(pages), pages.count(), stem=True).postings.select("word", "doc_id", F.round("tf", 9).alias("tf"), "importance")


@query("snippet_clean", f"SELECT page_id, {O.clean('html')} AS text FROM pages")
def snippet_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", clean_html(F.col("html")).alias("text"))


@query("highlight", f"SELECT doc_id, {O.marked('text', ['the', 'oned'])} AS text FROM documents")
def highlight_(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", highlight(F.col("text"), ["the", "oned"]).alias("text"))


# ---- streaming ------------------------------------------------------------------------------------


@query("stream_query_counts", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, max(ts) AS last_added
 FROM events
 GROUP BY 1, 2""")
def stream_query_counts(spark, sf_dir):
    """The query log counted by hour, from a stream."""
    at = Rounds(spark).root
    counts = window_counts(read_stream(spark, sf_dir, "events"))
    rows = keep_latest(counts, f"{at}/counts", f"{at}/state")
    kind = table(spark, sf_dir, "events").schema["ts"].dataType.simpleString()
    return rows.select(F.col("window_start").cast(kind).alias("window_start"), "event_type", "n", F.col("last_added").cast(kind).alias("last_added"))
