from collections import defaultdict

import numpy as np
import llm_oracle as oracle
from pyspark.sql import types as T

from tokenloom.llm import caps, components, queries


def brute(rows, least=0.93):
    sound = [i for i, (k, v, l) in enumerate(rows) if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent, n = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, i in enumerate(sound):
        for j in sound[x + 1 :]:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= least:
                n[i] += 1
                n[j] += 1
                parent[find(i)] = find(j)
    low = defaultdict(lambda: None)
    for i in sound:
        low[find(i)] = min((x for x in (low[find(i)], rows[i][0]) if x is not None), default=None)
    ok = set(sound)
    return sorted(((k, n[i], c := low[find(i)] if i in ok else k, c == k) for i, (k, _, _) in enumerate(rows)), key=repr)


def test_query(spark, sf):
    assert oracle.compare(queries.op2_cap_filters(spark, sf), queries.ORACLES["op2_cap_filters"], sf) > 0


def test_decode_lists_exactly_the_best_filters():
    rng = np.random.default_rng(3)
    for dim in (2, 12, 64):
        v = rng.normal(size=dim)
        a, b = caps.scores(v / np.linalg.norm(v), 32)
        total = (a[:, None] + b).ravel()
        got = caps.decode(v / np.linalg.norm(v), 32)
        assert len(set(got)) == caps.LISTED
        assert np.allclose(np.sort(total[got]), np.sort(total)[-caps.LISTED :])


def test_recall_at_the_threshold():
    """Pairs at cosine 0.93 share a filter, whatever the width and the fineness of the code."""
    rng = np.random.default_rng(5)
    for dim, vectors, pairs in ((16, 10_000_000, 300), (64, 10_000, 1000), (64, 10_000_000, 400), (256, 1_000_000, 200), (768, 10_000, 100)):
        hit, words = 0, caps.words_for(vectors, dim)
        for _ in range(pairs):
            v, w = rng.normal(size=dim), rng.normal(size=dim)
            v /= np.linalg.norm(v)
            w -= (w @ v) * v
            w /= np.linalg.norm(w)
            hit += bool(np.intersect1d(caps.decode(v, words), caps.decode(0.93 * v + np.sqrt(1 - 0.93**2) * w, words)).size)
        assert hit >= 0.975 * pairs


def test_filters_do_not_fill_up():
    """Ten times the vectors: hardly more others to compare with."""
    rng = np.random.default_rng(6)
    per = []
    for n in (3000, 30_000):
        words, of = caps.words_for(n, 64), defaultdict(int)
        for v in rng.normal(size=(n, 64)):
            for f in caps.decode(v / np.linalg.norm(v), words).tolist():
                of[f] += 1
        per.append(sum(c * (c - 1) for c in of.values()) / n)
    assert per[1] < 2 * max(per[0], 10)


def test_pairs_count_in_their_first_filter():
    rng = np.random.default_rng(7)
    lists = [sorted(rng.choice(60, 8, replace=False).tolist()) for _ in range(50)]
    got = caps._shared_before(lists, 30)
    assert all(got[i, j] == bool({x for x in lists[i] if x < 30} & set(lists[j])) for i in range(50) for j in range(50) if i != j)
    linked = rng.random((60, 60)) < 0.02
    linked |= linked.T
    np.fill_diagonal(linked, False)
    edges = caps._forest(linked)
    root = list(range(60))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in edges:
        assert linked[i, j] and find(i) != find(j)
        root[find(i)] = find(j)
    assert all(find(i) == find(j) for i, j in zip(*np.nonzero(linked), strict=True))


SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("n", T.StringType()), T.StructField("gid", T.StringType())])


def test_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = [float(np.float32(x)) for x in rng.normal(size=16)]
    near = [x * 1.01 + 0.01 for x in v]
    rows = [(5, v, 1), (3, v, 1), (3, v, 1), (9, near, 1), (9, [-x for x in v], 1), (4, v, 2), (7, v, None), (8, None, 1), (10, [], 1), (11, [0.0] * 16, 1), (12, [float("nan"), *v[1:]], 1), (13, [None, *v[1:]], 1), (14, [float("inf"), *v[1:]], 1), (15, v[:8], 1), (None, v, 1), (16, [x * 1e30 for x in v], 1)]
    rows = [(k, None if e is None else [None if x is None else float(np.float32(x)) for x in e], lab) for k, e, lab in rows]
    for i in range(40):
        rows.append((100 + i, [float(np.float32(x + 0.03 * y)) for x, y in zip(v, rng.normal(size=16), strict=True)], 1))
    df = spark.createDataFrame([(k, e, lab, None, "clash") for k, e, lab in rows], SCHEMA)
    got = sorted((tuple(r) for r in caps.near_vectors(df).collect()), key=repr)
    want = brute(rows)
    assert [(a, b, c) for a, b, c, _ in got] == [(a, b, c) for a, b, c, _ in want]
    assert caps.near_vectors(df.limit(0)).count() == 0
    # Small blocks give the same.
    monkeypatch.setattr(caps, "in_blocks", lambda rows, keys, id_col, total: components.in_blocks(rows, keys, id_col, total, size=5))
    assert sorted((tuple(r) for r in caps.near_vectors(df).collect()), key=repr) == got


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)
