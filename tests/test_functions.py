from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleaner.functions.porter import stem_text, stem_texts, stem_word, stems
from gleaner.functions.snippets import NO_PREVIEW, clean_html, highlight, snippet
from gleaner.functions.text import is_valid_word, read_stop_words, tokens
from gleaner.functions.urls import absolute_url, filter_params, normalize_url, url_host
from gleaner.operators.suggest import prefix_table, recent_queries, suggest_popular, suggest_terms
from gleaner.plans.query import Both, Component, parse, query_words

STEMS = dict(caresses="caress", ponies="poni", ties="ti", cats="cat", feed="feed", agreed="agre", disabled="disabl", matting="mat", mating="mate", meetings="meet", happy="happi", relational="relat", hopping="hop", falling="fall", hissing="hiss", filing="file", sky="sky", conformabli="conform", radicalli="radic", vietnamization="vietnam", triplicate="triplic", formative="form", hopeful="hope", goodness="good", revival="reviv", adoption="adopt", controlling="control", rate="rate", cease="ceas", probate="probat", a="a", by="by", enjoying="enjoi", yellow="yellow")


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_stems(spark):
    words = spark.createDataFrame([(w,) for w in STEMS], "word string")
    assert {r.word: r.stem for r in stems(words).collect()} == STEMS
    assert {w: stem_word(w) for w in STEMS} == STEMS


def test_stem_text(spark):
    assert stem_text("Running, cats' 42!") == "run, cat' 42!" and stem_text(None) == ""
    df = spark.createDataFrame([(1, "ponies & ties"), (2, None)], "k long, value string")
    assert [r.value for r in stem_texts(df).orderBy("k").collect()] == ["poni & ti", None]


def test_valid_words(spark):
    rows = spark.createDataFrame([(w,) for w in ("it's", "x2", "foo_bar", "a", "the", "python", "x" * 45, "x" * 46)], "w string")
    assert [r.w for r in rows.where(is_valid_word(F.col("w"))).collect()] == ["python", "x" * 45]
    assert one(spark, tokens(F.lit("It's 'Quoted' snake_case The Pythons, naïve"))) == ["quoted", "pythons"]
    assert one(spark, tokens(F.lit(None).cast("string"))) == []


def test_stop_word_file(spark, tmp_path):
    (tmp_path / "stop.txt").write_text(" The\n\nOF \n")
    assert read_stop_words(spark, str(tmp_path / "stop.txt")) == {"the", "of"}
    assert read_stop_words(spark, str(tmp_path / "none.txt")) == frozenset()


@pytest.mark.parametrize(
    "url,want",
    [
        ("HTTP://U@Ex.com:80/a/../b//?utm=1&Q=x&page=2&Q=x#f", "http://ex.com/b?Q=x&page=2"),
        ("https://ex.com", "https://ex.com/"),
        ("https://ex.com:8443/x/", "https://ex.com:8443/x"),
        ("http://ex.com/a/./b/../../..", "http://ex.com/"),
        ("mailto:a@b.c", None),
        ("not a url", None),
        (None, None),
    ],
)
def test_normalize_url(spark, url, want):
    assert one(spark, normalize_url(F.lit(url).cast("string"))) == want


def test_url_parts(spark):
    assert one(spark, url_host(F.lit("https://WWW.Ex.com/x"))) == "www.ex.com"
    assert one(spark, url_host(F.lit("nothing"))) == ""
    assert one(spark, filter_params(F.lit("a=1&ID=2&sort=x&ID=2"))) == "ID=2&sort=x"
    base = F.lit("http://h.com/a/b?x#y")
    for href, want in {"/c": "http://h.com/c", "c": "http://h.com/a/c", "//o.org/c": "http://o.org/c", "http://z.de": "http://z.de", "#t": "http://h.com/a/b?x#t"}.items():
        assert one(spark, absolute_url(base, F.lit(href))) == want


def test_parse():
    t = parse("a OR b AND c")
    assert isinstance(t, Both) and t.op == "OR" and [x.word for x in t.right.terms] == ["b", "and", "c"]
    assert isinstance(parse(" OR a"), Component) and [x.word for x in parse(" OR a").terms] == ["or", "a"]
    t = parse('"a b" AND c')
    assert t.left.phrase and not t.right.phrase
    assert parse('"').terms == () and parse("  ") is None and parse(None) is None
    assert [x.word for x in query_words(parse("a b AND b"))] == ["a", "b", "b"]
    assert parse("running The", stem=True, drop_stop_words=True).terms[0].key == "run"
    assert len(parse("running The", stem=True, drop_stop_words=True).terms) == 1


def test_snippets(spark):
    html = "<p>One. <b>Two</b> &amp; three</p><script>x<y</script><!-- gone -->"
    assert one(spark, clean_html(F.lit(html))) == "One. Two & three"
    assert one(spark, highlight(F.lit("The the then"), ["the"])) == "<strong>The</strong> <strong>the</strong> then"
    assert "<strong>needle</strong>" in one(spark, snippet(F.lit("x y. " * 100 + "a needle here. " + "z w. " * 100), ["needle"]))
    assert one(spark, snippet(F.lit(""), ["a"])) == NO_PREVIEW
    assert one(spark, clean_html(F.lit("a&nbsp;b\u00a0c\x07d , ! e...f&#160;g&hellip;h\n\n i"))) == "a b cd. . e. f g h i"
    assert one(spark, snippet(F.lit("First part. The needle lies here. Last part"), ["needle"])) == "...The <strong>needle</strong> lies here..."
    assert one(spark, snippet(F.lit("No such word. Second"), ["needle"])) == "No such word. Second"
    assert one(spark, highlight(F.lit("a<the>b strong"), ["the", "strong"])) == "a<<strong>the</strong>>b <strong>strong</strong>"


def test_suggestions(spark):
    words = [("hello", 10), ("hell", 15), ("heaven", 8), ("goodbye", 20), ("good", 18), ("go", 12), ("goose", 5), ("greeting", 17), ("god", 13), ("goodnight", 25), ("goodnight moon", 26)]
    df = spark.createDataFrame(words, "word string, freq long")
    got = lambda p: [r.word for r in suggest_popular(df, p).orderBy("rank").collect()]
    assert got("go") == ["goodnight moon", "goodnight", "goodbye", "good", "god", "go", "goose"]
    assert got("he") == ["hell", "hello", "heaven"]
    table = prefix_table(df)
    assert [r.word for r in table.where("prefix = 'good'").orderBy("rank").collect()] == ["goodnight moon", "goodnight", "goodbye", "good"]
    again = df.union(spark.createDataFrame([("hello", 22), ("goodbye", 30)], df.schema))
    assert [r.word for r in suggest_popular(again, "he").orderBy("rank").collect()] == ["hello", "hell", "heaven"]
    assert [r.word for r in suggest_terms(df, "go").orderBy("rank").collect()] == ["go", "god", "good", "goodbye", "goodnight"]
    assert suggest_terms(df, " ").count() == 0


def test_recent_queries(spark):
    now = datetime(2024, 5, 1, 20, 0)
    log = spark.createDataFrame([("new", 1, now - timedelta(hours=12, minutes=59)), ("old", 2, now - timedelta(hours=13))], "query string, count long, last_added timestamp")
    assert [r.query for r in recent_queries(log, now).collect()] == ["new"]
