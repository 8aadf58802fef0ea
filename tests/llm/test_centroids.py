import hashlib

import numpy as np
import pytest

from tokenloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, q string, id string"


def brute(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)
    c = [q for _, q in first[:k]]
    distance = lambda q, j: sum((a - b) ** 2 for a, b in zip(q, c[j], strict=True))
    assign = lambda: [min(range(len(c)), key=lambda j: (distance(q, j), j)) for _, q in kept]
    for _ in range(rounds):
        at = assign()
        c = [[sum(col) // at.count(j) for col in zip(*[q for (_, q), a in zip(kept, at, strict=True) if a == j], strict=True)] if j in at else c[j] for j in range(len(c))]
    at = assign()
    own = [distance(q, a) for (_, q), a in zip(kept, at, strict=True)]
    return sorted(((i, a, d, sum(x for x, b in zip(own, at, strict=True) if b == a), sum(own), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), a, d in zip(kept, at, own, strict=True)), key=repr)


def got(spark, rows, **options):
    df, _ = centroids.cluster(spark.createDataFrame([(*r, 1, "clash", "clash", "clash") for r in rows], SCHEMA), **options)
    return sorted((tuple(r) for r in df.select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def vectors(seed, n):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in rng.normal(0, 0.3, 64).astype(np.float32)]) for i in range(n)]


@pytest.mark.parametrize("n", [1, 7, 16, 300])
def test_against_brute_force(spark, n):
    rows = vectors(n, n)
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = vectors(1, 40)
    rows += [(None, rows[0][1]), (3, rows[3][1]), (3, rows[4][1]), (50, [0.0] * 64), (51, [0.0] * 64), (52, [-0.001] * 64)]
    odd = [(60, None), (61, []), (62, [1.0] * 63), (63, [1.0] * 65), (64, [None] + [1.0] * 63), (65, [float("nan")] + [0.0] * 63), (66, [float("inf")] + [0.0] * 63)]
    assert got(spark, rows + odd) == brute(rows)
    assert got(spark, rows + odd + [(67, [3e38] * 64)]) == brute(rows)  # beyond the stated size
    assert got(spark, odd) == [] and got(spark, []) == []


def test_ties_and_equal_vectors(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(100)]  # most centroids are equal, and stay empty
    assert got(spark, rows) == brute(rows)


def test_partial_search_is_the_full_search():
    rng = np.random.default_rng(3)
    for spread in (1, 3, 1000):
        x, c = rng.integers(-spread, spread + 1, (500, 64)), rng.integers(-spread, spread + 1, (16, 64))
        number, distance = centroids.nearest(x, c, rng.permutation(64))
        full = ((x[:, None] - c) ** 2).sum(axis=2)
        assert (number == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert centroids.nearest(np.zeros((0, 64), np.int64), c, np.arange(64))[0].shape == (0,)
