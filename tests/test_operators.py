import pytest
from pyspark.sql import functions as F

from gleaner import api
from gleaner.operators import crawl as C
from gleaner.operators import pagerank as P
from gleaner.operators.index import Index, blocks_of, build_index
from gleaner.operators.match import match, phrase_ok
from gleaner.operators.ranking import page_args, page_of, scores
from gleaner.plans.query import parse, query_words
from gleaner.sources.html import html_blocks, parse_blocks
from gleaner.sources.store import last_commit, load_links, save_crawl, with_ids
from gleaner.streaming.ingest import drop_repeated, index_stream, run_once

DOCS = [(1, "python engine\nfast python search engine"), (2, "search\npython near engine"), (3, "cooking\nslow food"), (4, None), (5, "")]


@pytest.fixture(scope="module")
def index(spark):
    return build_index(blocks_of(spark.createDataFrame(DOCS, "doc_id long, text string")), stop=frozenset())


def found(index, text):
    return {r.doc_id for r in match(index, parse(text)).select("doc_id").distinct().collect()}


def test_index(index):
    rows = {(r.word, r.doc_id): r for r in index.postings.collect()}
    assert rows["python", 1].tf == pytest.approx((5 + 1) / 6)
    assert rows["python", 1].importance == 5.0 and rows["python", 1].positions == [0, 1]
    assert {r.word: r.df for r in index.vocab.collect()}["python"] == 2


def test_boolean(index):
    assert found(index, "python OR food") == {1, 2, 3}
    assert found(index, "python AND fast") == {1}
    assert found(index, "python NOT fast") == {2}
    assert found(index, '"python engine"') == {1, 2}
    assert found(index, '"engine missing"') == set()
    assert found(index, '"') == set()


def test_phrase_walk(spark):
    a = lambda *x: F.array(*(F.lit(i) for i in x))
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(phrase_ok([a(0), a(1, 2, 3, 4, 6, 9)])) and one(phrase_ok([a(0), a(2, 5)]))
    assert not one(phrase_ok([a(0), a(4)])) and not one(phrase_ok([a(5), a(1, 2)]))
    # the place moves on while the list is walked: 1, 2 and 4 count, so 7 is within reach and 8 isn't
    assert one(phrase_ok([a(0), a(1, 2, 4), a(7)])) and not one(phrase_ok([a(0), a(1, 2, 4), a(8)]))
    assert one(phrase_ok([a(3)]))


def test_pages(spark, index):
    tree = parse("python")
    ranked = scores(match(index, tree), query_words(tree))
    assert [r.doc_id for r in page_of(ranked, 0, 1).collect()] == [1]
    assert page_of(ranked, 7, 10).count() == 0
    assert page_args(0, 0) == (0, 10) and page_args(2, 101) == (2, 10)
    with pytest.raises(ValueError):
        page_args(-1, 10)
    empty = build_index(blocks_of(spark.createDataFrame([], "doc_id long, text string")))
    assert page_of(scores(match(empty, tree), query_words(tree))).count() == 0


def test_sample_scores(spark):
    """tf = count / length, idf = log10(N / df), ranks mixed in."""
    docs = [(101, 4, 3, 180, 0.9), (102, 2, 1, 120, 0.5), (108, 0, 4, 68, 0.5), (109, 3, 2, 70, 0.6)]
    import math

    rows = [(d, t, c / n, math.log10(10000 / df)) for d, b, r, n, _ in docs for t, c, df in (("banana", b, 150), ("recipe", r, 80)) if c]
    m = spark.createDataFrame(rows, "doc_id long, term string, tf double, idf double")
    ranks = spark.createDataFrame([(d, p) for d, *_, p in docs], "doc_id long, page_rank double")
    got = {r.doc_id: r.score for r in scores(m, query_words(parse("banana recipe")), ranks).collect()}
    assert got[101] == pytest.approx(0.7 * (4 / 180 * math.log10(10000 / 150) + 3 / 180 * math.log10(125)) + 0.27, abs=1e-8)


def test_pagerank(spark):
    two = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    assert {r.id: r.page_rank for r in P.pagerank(two).collect()} == {1: 0.5, 2: 0.5}
    hang = spark.createDataFrame([(1, 2), (1, 3), (3, 3)], "src long, dst long")
    assert sum(r.page_rank for r in P.pagerank(hang).collect()) == pytest.approx(1.0)
    assert P.pagerank(two.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, 0.1), (9, 0.7)], "doc_id long, page_rank double")
    assert {r.doc_id: r.page_rank for r in P.write_back(docs, P.pagerank(two)).collect()} == {1: 0.5, 9: 0.7}


def test_blocks():
    got = parse_blocks("<title>T</title><div>a<p>b<p>c<span>d</span></div><script>x</p></script><ul><li>e<li>f</ul>")
    assert [(b["tag"], b["text"]) for b in got] == [("title", "T"), ("div", "a b cd"), ("p", "b"), ("p", "cd"), ("span", "d"), ("li", "e"), ("li", "f")]
    assert parse_blocks(None) == []


PAGES = [
    (1, "http://a.com/", "<title>A</title><a href='/x'>x</a><a href='http://b.org/'>b</a> python"),
    (2, "http://a.com/x", "<title>X</title><a href='/'>home</a> python engine"),
    (3, "http://b.org/", "<title>B</title>python food"),
    (4, "http://a.com/copy", "<title>B</title>python food"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_crawl(spark, pages, tmp_path):
    seeds = spark.createDataFrame([(0, "http://A.com:80/#top"), (1, "nonsense")], "seq long, url string")
    out = C.crawl(spark, seeds, C.offline_fetcher(pages))
    assert {r.url for r in out.documents.collect()} == {"http://a.com/", "http://a.com/x", "http://b.org/"}
    edges = P.link_graph(out.links, out.documents)
    assert edges.count() == 3
    rules = spark.createDataFrame([("http://a.com", "User-agent: *\nDisallow: /x")], "origin string, robots_txt string")
    allowed = C.crawl(spark, seeds, C.offline_fetcher(pages), robots=rules)
    assert {r.title for r in allowed.documents.collect()} == {"A", "B"}
    save_crawl(out.documents.select("doc_id", "url", "title", "html", "hash"), out.links, str(tmp_path), 1)
    assert load_links(spark, str(tmp_path)).count() == 3
    visited, hosts, hashes = C.resume(out.documents)
    assert C.frontier(seeds, visited).count() == 0 and hosts.count() == 2 and hashes.count() == 3


def test_crawl_fills_hosts(spark):
    """Dead and copied pages give their places to the rest of a host's seeds; the queue shows what is left."""
    alive = [(f"http://h.com/{i}", "copy" if i < 6 else f"page {i}") for i in range(3, 12)] + [("http://g.com/", "other")]
    pages = spark.createDataFrame(alive, "url string, html string")
    seeds = spark.createDataFrame([(i, f"http://h.com/{i}") for i in range(12)] + [(12, "http://g.com/")], "seq long, url string")
    out = C.crawl(spark, seeds, C.offline_fetcher(pages), per_host=4)
    assert [r.url[-6:] for r in out.documents.where("url LIKE '%h.com%'").orderBy("doc_id").collect()] == [f".com/{i}" for i in (3, 6, 7, 8)]
    assert out.documents.count() == 5 and out.queue.isEmpty()
    few = C.crawl(spark, seeds, C.offline_fetcher(pages), per_host=20, page_cap=3)
    assert [r.url[-6:] for r in few.documents.orderBy("doc_id").collect()] == [f".com/{i}" for i in (3, 6, 7)]
    assert {r.url[-6:] for r in few.queue.collect()} >= {"com/11", "g.com/"}


def test_caps(spark):
    rows = spark.createDataFrame([(i, f"http://h.com/{i}") for i in range(30)], "seq long, url string")
    assert C.host_cap(rows).count() == 20
    taken = spark.createDataFrame([("h.com", 15)], "host string, n long")
    assert [r.seq for r in C.host_cap(rows, taken=taken).orderBy("seq").collect()] == [0, 1, 2, 3, 4]
    assert C.frontier(rows, hosts=spark.createDataFrame([("h.com", 20)], "host string, n long")).count() == 0


def test_dedup(spark, pages):
    assert [r.page_id for r in C.content_dedup(pages, order="page_id").orderBy("page_id").collect()] == [1, 2, 3]
    known = C.content_dedup(pages.where("page_id = 1"), order="page_id")
    assert [r.page_id for r in C.content_dedup(pages, order="page_id", known=known).orderBy("page_id").collect()] == [2, 3]


def test_seeds(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("http://a.com\n\nftp://b.com\n https://c.com \n")
    assert [r.url for r in C.read_seeds(spark, str(tmp_path / "seeds.txt")).orderBy("seq").collect()] == ["http://a.com", "https://c.com"]
    C.write_seeds(spark.createDataFrame([("http://n.com",)], "url string"), str(tmp_path / "queue"))
    assert C.read_seeds(spark, str(tmp_path / "queue")).count() == 1


def test_ids(spark):
    known = spark.createDataFrame([(3, "b"), (7, "b"), (4, "z")], "doc_id long, url string")
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "url string")
    assert sorted((r.url, r.doc_id) for r in with_ids(rows, known).collect()) == [("a", 8), ("a", 8), ("b", 3), ("c", 9)]


def test_api(spark, pages, tmp_path):
    docs = pages.select(F.col("page_id").alias("doc_id"), "url", F.lit("t").alias("title"), "html")
    built = build_index(html_blocks(pages), stem=True)
    blocks = pages.select(F.col("page_id").alias("doc_id"), F.array(F.struct(F.lit("p").alias("tag"), F.col("html").alias("text"))).alias("blocks"))
    built = build_index(blocks, stem=True)
    built.write(str(tmp_path / "index"))
    index = Index.read(spark, str(tmp_path / "index"), stemmed=True)
    r = api.search(spark, index, docs, "pythons", size=2)
    assert r.total == 4 and r.results.count() == 2 and '"totalCount": 4' in r.json()
    assert "<strong>food</strong>" in api.search(spark, index, docs, "food").results.first().snippet
    assert api.suggest(index, "pyth") == ["python"]
    with pytest.raises(ValueError):
        api.search(spark, index, docs, "  ")
    log = spark.createDataFrame([("python food", 3), ("python", 9)], "query string, count long")
    assert api.suggest_from_log(log, "py") == ["python", "python food"]


def test_streams(spark, pages, tmp_path):
    src = str(tmp_path / "in")
    pages.write.parquet(src)
    read = lambda: spark.readStream.schema(pages.schema).parquet(src)
    run_once(drop_repeated(read()), str(tmp_path / "out"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    tagged = spark.readStream.schema(pages.schema).parquet(src).withColumn("html", F.concat(F.lit("<p>"), "html", F.lit("</p>")))
    index_stream(tagged, str(tmp_path / "idx"), str(tmp_path / "c2"))
    index_stream(tagged, str(tmp_path / "idx"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "idx")).where("word = 'python'").count() == 4


def test_crawl_goes_on(spark, tmp_path):
    """A crawl that stops after a round goes on where it stood, with hosts and contents known."""
    links = lambda i: "".join(f"<a href='http://h.com/{j}'>x</a>" for j in (2 * i + 1, 2 * i + 2))
    rows = [(f"http://h.com/{i}", f"page {i if i != 5 else 3}" + (links(i) if i not in (3, 5) else "")) for i in range(15)]
    pages = spark.createDataFrame(rows, "url string, html string")
    seeds = spark.createDataFrame([(0, "http://h.com/0")], "seq long, url string")
    whole = C.crawl(spark, seeds, C.offline_fetcher(pages), per_host=9)
    path = str(tmp_path / "crawl")
    for turn in range(6):
        out = C.crawl(spark, seeds, C.offline_fetcher(pages), per_host=9, rounds=1, path=path)
        assert last_commit(spark, path) <= turn + 1
    ids = lambda c: [(r.doc_id, r.url) for r in c.documents.orderBy("doc_id").collect()]
    assert ids(out) == ids(whole) and len(ids(whole)) == 9 and not any(u.endswith("/5") for _, u in ids(out))
    assert out.links.count() == whole.links.count() and out.queue.isEmpty()
    assert C.crawl(spark, seeds, C.offline_fetcher(pages), per_host=9, path=path).documents.count() == 9


def test_http_fetcher(spark):
    """Status, content type, charset and time limit, against a server on this machine."""
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/slow":
                time.sleep(3)
            self.send_response(404 if self.path == "/gone" else 200)
            self.send_header("Content-Type", {"/text": "text/plain"}.get(self.path, "Text/HTML; charset=latin-1"))
            self.end_headers()
            self.wfile.write(f"<p>caf\xe9 {self.headers['User-Agent'][:7]}".encode("latin-1"))

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    rows = spark.createDataFrame([(k, at + p) for k, p in enumerate(("/ok", "/gone", "/text", "/slow"))] + [(4, "http://127.0.0.1:1/"), (5, "nonsense"), (6, None)], "seq long, url string")
    got = C.http_fetcher(timeout=1.0)(rows.where("url IS NOT NULL")).collect()
    server.shutdown()
    assert [(r.seq, r.html) for r in got] == [(0, "<p>caf\xe9 Mozilla")] and got[0].content_type.startswith("Text/HTML")


def test_content_types(spark):
    kinds = spark.createDataFrame([("text/html; charset=x",), ("TEXT/HTML",), ("text/plain",), (None,)], "t string")
    assert [r.x for r in kinds.select(C.is_html(F.col("t")).alias("x")).collect()] == [True, True, False, False]


def test_stored_index(spark, index, tmp_path):
    """Lookups in a stored index open the buckets of their words alone and give the same scores."""
    index.write(str(tmp_path / "index"), buckets=8)
    stored = Index.read(spark, str(tmp_path / "index"))
    for text in ("python", "python engine", '"python engine"', "python AND fast", "python OR food", "nothing"):
        tree = parse(text)
        rows = lambda i: [(r.doc_id, r.score) for r in page_of(scores(match(i, tree), query_words(tree))).collect()]
        assert rows(stored) == rows(index)
    plan = stored.postings_of(["python", "food"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [(bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan


def test_stems_large_vocabulary(spark, monkeypatch):
    """A vocabulary too large to broadcast gives the same postings."""
    from gleaner.operators import index as I

    blocks = blocks_of(spark.createDataFrame([(1, "running runs\nrun likes"), (2, "cats cat"), (3, "the")], "doc_id long, text string"))
    rows = lambda: sorted((r.word, r.doc_id, r.tf, r.importance, tuple(r.positions)) for r in build_index(blocks, stem=True).postings.collect())
    want = rows()
    assert ("run", 1, 11 / 3, 5.0, (0, 1)) in [(w, d, pytest.approx(t), i, p) for w, d, t, i, p in want]
    monkeypatch.setattr(I, "BROADCAST_WORDS", 0)
    assert rows() == want


def test_numbered(spark):
    from gleaner.sources.scratch import Rounds, numbered

    df = spark.createDataFrame([(f"{i * 7919 % 500:03d}",) for i in range(500)], "url string").repartition(5)
    got = numbered(df, [F.col("url")], "n", lambda x: Rounds(spark).keep(x)).collect()
    assert sorted((r.url, r.n) for r in got) == [(f"{i:03d}", i + 1) for i in range(500)]


def test_shared_folder(monkeypatch):
    """Off a local master a missing shared folder is an error, not a local one."""
    from types import SimpleNamespace

    from gleaner.sources import scratch

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda k: None)))
    with pytest.raises(RuntimeError):
        scratch.shared_dir(session)
