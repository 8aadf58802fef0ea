"""Runs oracle SQL in DuckDB over the tables of a folder."""

import os

import duckdb


def run(sql: str, sf: str, tables=("documents", "labels", "embeddings", "pages", "benchmark", "conversations")):
    con = duckdb.connect()
    for t in tables:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def compare(df, sql: str, sf: str):
    names, rows = run(sql, sf)
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(r[c] for c in sorted(names)) for r in df.collect()), key=repr)
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in rows), key=repr)
    assert got == want
    return len(got)
