import os
import re

import duckdb
import pytest

from gleaner import queries as Q
from gleaner.functions import porter

from .helpers import check


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_against_sql(spark, sf, name):
    check(spark, sf, Q.QUERIES[name], Q.ORACLES[name])


@pytest.mark.parametrize("name", ["html_blocks", "html_headings", "page_index"])
def test_references_cut_short(spark, sf, tmp_path, name):
    """Titles cut within a reference, as some pages of sf0.1 have them."""
    for f in os.listdir(sf):
        os.symlink(f"{sf}/{f}", tmp_path / f)
    os.remove(tmp_path / "pages.parquet")
    cut = ["R&amp;D and&amp", "that&am", "all&", "said &quot", "&amp;&amp;&amp", "a&amp;lt;b", "&nosuch; Q&A"]
    pages = ", ".join(f"({i}, 'http://a.com/{i}', '<title>{t}</title><article><h1>{t}</h1><p>{t} python.</p></article>')" for i, t in enumerate(cut))
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {pages}) x(page_id, url, html)) TO '{tmp_path}/pages.parquet'")
    check(spark, str(tmp_path), Q.QUERIES[name], Q.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_runs(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_stem_text_reads_whole_texts(spark, sf):
    want = {r.doc_id: r.text and re.sub("[A-Za-z]+", lambda m: porter.stem_word(m[0]), r.text) for r in Q.table(spark, sf, "documents").collect()}
    assert {r.doc_id: r.value for r in Q.QUERIES["stem_text"](spark, sf).collect()} == want
