"""Runs a query's SQL in DuckDB and compares it with the DataFrame, row by row."""

import glob
import os

import duckdb

TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def compare(df, sql, sf):
    cur = connect(sf).execute(sql)
    names = [c[0] for c in cur.description]
    kinds = {c[0]: str(c[1]) for c in cur.description}
    assert sorted(names) == sorted(df.columns)
    bad = {c: (k, kinds[c]) for c, k in df.dtypes if TYPES.get(k) != kinds[c]}
    order = sorted(names)
    want = sorted((tuple(r[names.index(c)] for c in order) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if repr(g) != repr(w)]
    assert not wrong, f"{order}: {len(wrong)} of {len(got)} differ, as {wrong[:3]}"
    assert not bad, bad
    return len(got)
