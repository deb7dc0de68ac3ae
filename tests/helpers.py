"""Side-by-side runs of a query and its SQL."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        p = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.sql(f"create view {t} as select * from '{p}'")
    return c


def _rows(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(repr(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


def check(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    rel = duck(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(rel.columns, rel.fetchall())
