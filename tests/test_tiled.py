import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.operators import tiled


def brute(q, k, v, qp, kp, causal):
    s = q @ k.T / np.sqrt(q.shape[1])
    if causal:
        s = np.where(kp <= qp[:, None], s, -np.inf)
    out = []
    for row in s:
        if not np.isfinite(row).any():
            out.append(None)
            continue
        e = np.exp(row - row.max())
        out.append(e / e.sum() @ v)
    return out


@pytest.mark.parametrize("causal", [True, False])
@pytest.mark.parametrize("block,run", [(1, 1), (3, 2), (7, 1), (64, 16)])
def test_attention_equals_brute_force(spark, causal, block, run):
    rng = np.random.default_rng(block)
    q_rows, kv_rows, want = [], [], {}
    for s, n in ((5, 1), (6, 13), (-2, 20)):
        k, v = rng.normal(size=(2, n, 4)), rng.normal(size=(2, n, 3))  # two key heads
        seen = rng.random(n) < 0.8  # some keys are padding
        for h in range(2):
            kv_rows += [(s, h, p, k[h, p].tolist(), v[h, p].tolist()) for p in range(n) if seen[p]]
        for h in range(4):
            q = rng.normal(size=(n, 4)) * 3
            q_rows += [(s, h, p, q[p].tolist()) for p in range(n)]
            at = np.flatnonzero(seen)
            for p, o in enumerate(brute(q, k[h // 2][at], v[h // 2][at], np.arange(n), at, causal)):
                want[s, h, p] = o
    q = spark.createDataFrame(q_rows, "sample_id int, head int, pos int, q array<double>")
    kv = spark.createDataFrame(kv_rows, "sample_id int, head int, pos int, k array<double>, v array<double>")
    got = tiled.tiled_attention(q, kv, head="head", kv_repeat=2, causal=causal, block=block, run=run)
    assert got.schema["sample_id"].dataType.simpleString() == "int"
    rows = {(r["sample_id"], r["head"], r["pos"]): r["out"] for r in got.collect()}
    assert rows.keys() == want.keys()
    for key, o in want.items():
        assert (rows[key] is None) == (o is None)
        if o is not None:
            assert np.allclose(rows[key], o, atol=1e-12)


def test_empty_inputs(spark):
    q = spark.createDataFrame([(1, 0, [1.0]), (1, 5, [2.0])], "sample_id long, pos long, q array<double>")
    kv = spark.createDataFrame([], "sample_id long, pos long, k array<double>, v array<double>")
    assert sorted(tiled.tiled_attention(q, kv, block=2).collect()) == [(1, 0, None), (1, 5, None)]
    assert tiled.tiled_attention(q.limit(0), kv).count() == 0


@pytest.mark.parametrize("strip", [2, 40])
def test_blocks_without_queries(spark, monkeypatch, strip):
    """Keys of blocks that no query is in, and queries far apart, in strips of several blocks or of one."""
    monkeypatch.setattr(tiled, "STRIP", strip)
    rng = np.random.default_rng(4)
    at = np.sort(rng.choice(400, 60, replace=False))
    asked = at[(at < 120) | (at > 260)]
    x, k, v = rng.normal(size=(3, 400, 4))
    q = spark.createDataFrame([(s, int(p), x[p].tolist()) for s in (1, 2) for p in asked], "sample_id long, pos long, q array<double>")
    kv = spark.createDataFrame([(s, int(p), k[p].tolist(), v[p].tolist()) for s in (1, 2) for p in at], "sample_id long, pos long, k array<double>, v array<double>")
    got = {(r["sample_id"], r["pos"]): r["out"] for r in tiled.tiled_attention(q, kv, block=8, run=2).collect()}
    want = brute(x[asked], k[at], v[at], asked, at, True)
    assert len(got) == 2 * len(asked)
    for s in (1, 2):
        assert np.allclose([got[s, p] for p in asked], want, atol=1e-12)


def test_what_is_sent_does_not_grow_with_the_square(spark):
    """A sequence of 512 blocks: each key once for every later block would be over 100 times the input."""
    n, store = 8192, spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(store.executorList(True).apply(i).totalShuffleWrite() for i in range(store.executorList(True).size()))
    rows = spark.range(n).select(F.lit(7).alias("sample_id"), F.col("id").alias("pos"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(i * F.col("id"))).alias("q"))
    kv = rows.select("sample_id", "pos", F.col("q").alias("k"), F.col("q").alias("v"))
    before = written()
    assert tiled.tiled_attention(rows, kv, block=16, run=2).where("out IS NULL").count() == 0
    assert written() - before < 20 * n * 3 * 8 * 8


def test_fold_is_associative():
    rng = np.random.default_rng(1)
    s, v = rng.normal(size=(6, 30)) * 50, rng.normal(size=(30, 2))
    s[0, :10] = -np.inf
    s[1] = -np.inf
    whole = tiled.fold(None, s, v)
    state = None
    for a in range(0, 30, 7):
        state = tiled.fold(state, s[:, a : a + 7], v[a : a + 7])
    assert np.allclose(whole[0], state[0]) and np.allclose(whole[1], state[1]) and np.allclose(whole[2], state[2])
    assert whole[1][1] == 0


def test_one_sample_of_many_positions(spark):
    """A single sequence of 100,000 positions; groups stay at two blocks."""
    n = 100_000
    rows = spark.range(n).select(F.lit(7).alias("sample_id"), F.col("id").alias("pos"), F.array(F.sin(F.col("id") / 7.0), F.cos(F.col("id") * 0.3)).alias("q"))
    kv = rows.select("sample_id", "pos", F.col("q").alias("k"), F.transform("q", lambda x: x * x + F.col("pos") / n).alias("v"))
    got = tiled.tiled_attention(rows, kv, block=4096).where("pos % 9973 = 5")
    p = np.arange(n)
    x = np.stack([np.sin(p / 7.0), np.cos(p * 0.3)], axis=1)
    v = x * x + p[:, None] / n
    out = {r["pos"]: r["out"] for r in got.collect()}
    assert sorted(out) == list(range(5, n, 9973))
    for i, o in out.items():
        e = np.exp(x[: i + 1] @ x[i] / np.sqrt(2))
        assert np.allclose(o, e @ v[: i + 1] / e.sum(), atol=1e-9)


@pytest.mark.parametrize("tile,height", [(1, 2), (4, 3), (5, 100), (64, 1024)])
def test_product_equals_numpy(spark, tile, height):
    rng = np.random.default_rng(tile)
    x, w, b = rng.normal(size=(11, 13)), rng.normal(size=(9, 13)), rng.normal(size=9)
    rows = spark.createDataFrame([(i - 4, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    entries = spark.createDataFrame([(o, i, float(w[o, i])) for o in range(9) for i in range(13)], "o int, i int, w double")
    bias = spark.createDataFrame([(o, float(b[o])) for o in range(9)], "o long, b double")
    tiles, shifts = tiled.weight_tiles(entries, tile=tile), tiled.bias_tiles(bias, tile=tile)
    pieces, options = tiled.row_pieces(rows, id_col="id", vec="v", tile=tile), {"groups": tiled.groups_of(11, height), "tile": tile}
    y = tiled.rows_of_pieces(tiled.tiled_linear(pieces, tiles, outputs=9, bias=shifts, **options))
    got = {r["id"]: r["v"] for r in y.collect()}
    assert sorted(got) == list(range(-4, 7))
    for i in range(11):
        assert np.allclose(got[i - 4], w @ x[i] + b)
    down = spark.createDataFrame([(o, i, float(w[i, o])) for o in range(13) for i in range(9)], "o int, i int, w double")
    out = tiled.tiled_mlp(pieces, tiles, tiles, tiled.weight_tiles(down, tile=tile), inner=9, outputs=13, **options)
    z = x @ w.T
    for r in tiled.rows_of_pieces(out).collect():
        assert np.allclose(r["v"], ((z / (1 + np.exp(-z)) * z) @ w)[r["id"] + 4])


def test_sparse_weights_odd_rows(spark):
    """Missing entries, tiles and whole rows of W are zeros; short vectors end in zeros; empty ones give nothing."""
    entries = spark.createDataFrame([(0, 0, 2.0), (3, 1, 5.0), (0, 5, 7.0), (9, 0, 1.0)], "o int, i int, w double")  # row 9 is beyond the outputs
    rows = spark.createDataFrame([(1, [1.0, 10.0]), (2, [0.0, 1.0, 0.0, 0.0, 0.0, 3.0]), (3, []), (4, None)], "id long, v array<double>")
    tiles, pieces = tiled.weight_tiles(entries, tile=2), tiled.row_pieces(rows, id_col="id", vec="v", tile=2)
    got = {r["id"]: r["v"] for r in tiled.rows_of_pieces(tiled.tiled_linear(pieces, tiles, outputs=7, groups=2, tile=2)).collect()}
    assert got == {1: [2, 0, 0, 50, 0, 0, 0], 2: [21, 0, 0, 5, 0, 0, 0]}
    assert tiled.tiled_linear(pieces.limit(0), tiles, outputs=7, groups=2, tile=2).count() == 0
    assert {tuple(r["x"]) for r in tiled.tiled_linear(pieces, tiles.limit(0), outputs=2, groups=2, tile=2).collect()} == {(0, 0)}
