import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom.operators import kernels as K
from tokenloom.plans.large import with_state_store
from tokenloom.streaming import decode

LAYERS, HEADS, KV, WIDTH = 3, 4, 2, 8
W = K.init_weights(K.backbone_shapes(WIDTH, LAYERS, HEADS, KV, 12), 5, 0.4)
rng = np.random.default_rng(3)


@pytest.mark.parametrize("block", [1, 4, 64])
def test_cache_equals_whole_sequence(block):
    x = rng.normal(size=(11, WIDTH))
    state, out, at = decode.DictState(), [], 0
    for n in (5, 1, 1, 4):
        out.append(decode.decode_step(x[at : at + n], at, decode.Cache(state, KV, block), W, LAYERS, HEADS))
        at += n
    assert np.allclose(np.concatenate(out), K.backbone(x, W, LAYERS, HEADS, KV))
    assert all(v[0] <= block for v in state.values()) and {k[0] for k in state} == set(range(LAYERS))


def run_stream(spark, tmp_path, parts, schema, transform, name):
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    q = transform(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.awaitTermination(240)
    return spark.table(name).collect()


def test_decode_over_micro_batches(spark, tmp_path):
    with_state_store(spark)
    x = rng.normal(size=(2, 2, 6, WIDTH))
    parts = [[(s, b, p, x[s, b, p].tolist()) for s in range(2) for b in range(2) for p in range(*span)] for span in ((0, 2), (2, 3), (3, 6))]
    rows = run_stream(spark, tmp_path, parts, "sample_id long, branch long, pos long, vec array<double>", lambda t: decode.decode_stream(t, W, layers=LAYERS, heads=HEADS, kv_heads=KV, block=4, most=2), "decoded")
    got = {(r["sample_id"], r["branch"], r["pos"]): r["out"] for r in rows}
    assert len(got) == len(rows) == 24
    for s in range(2):
        for b in range(2):
            assert np.allclose([got[s, b, p] for p in range(6)], K.backbone(x[s, b], W, LAYERS, HEADS, KV))


def test_a_gap_is_refused(spark):
    with_state_store(spark)
    rows = spark.createDataFrame([(1, 0, 0, [0.1] * WIDTH), (1, 0, 2, [0.1] * WIDTH)], "sample_id long, branch long, pos long, vec array<double>")
    with pytest.raises(Exception, match="without a gap"):
        decode.decode_stream(rows, W, layers=LAYERS, heads=HEADS, kv_heads=KV).collect()


def head():
    """Functions of a test are sent by value, as a script's would be."""

    def token(outputs, sample, step):
        return decode.guided(outputs, 2.0, 1.5)[:3] + 0.1 * step + sample

    def embed(t):
        return np.tile(t, 3)[:8] / 10

    return token, embed


def by_hand(x, n, sample):
    """The loop without a cache: every step runs all positions of all branches again."""
    seqs, out, (token, embed) = [list(b) for b in x], [], head()
    for step in range(n):
        last = np.stack([K.backbone(np.array(b), W, LAYERS, HEADS, KV)[-1] for b in seqs])
        out.append(token(last, sample, step))
        for b in seqs:
            b.append(embed(out[-1]))
    return np.array(out)


def test_generation_goes_on_in_a_later_batch(spark, tmp_path):
    with_state_store(spark)
    x = rng.normal(size=(2, 3, 5, WIDTH))
    schema = "sample_id long, branch long, pos long, vec array<double>, make long"
    first = [(s, b, p, x[s, b, p].tolist(), 2 if (b, p) == (0, 0) else None) for s in range(2) for b in range(3) for p in range(5)]
    token, embed = head()
    rows = run_stream(spark, tmp_path, [first, [(1, None, None, None, 3)], [(9, None, None, None, 1)]], schema, lambda t: decode.generate_stream(t, W, layers=LAYERS, heads=HEADS, kv_heads=KV, token=token, embed=embed, block=2), "generated")
    got = {(r["sample_id"], r["step"]): r["token"] for r in rows}
    assert sorted(got) == [(0, 0), (0, 1), *[(1, k) for k in range(5)]]  # a sample without a beginning makes nothing
    for s, n in ((0, 2), (1, 5)):
        assert np.allclose([got[s, k] for k in range(n)], by_hand(x[s], n, s))


def test_guided():
    o = np.array([[1.0], [10.0], [100.0]])
    assert decode.guided(o[:1], 5)[0] == 1 and decode.guided(o[:2], 3)[0] == 10 - 27 and decode.guided(o, 3, 2)[0] == 100 - 180 - 27


def test_long_sequence_in_a_table(spark):
    with_state_store(spark)
    n = 700
    rows = spark.range(n).select(F.lit(4).cast("long").alias("sample_id"), F.lit(0).cast("long").alias("branch"), F.col("id").alias("pos"), F.transform(F.sequence(F.lit(1), F.lit(WIDTH)), lambda k: F.sin(k * F.col("id"))).alias("vec"))
    got = {r["pos"]: r["out"] for r in decode.decode_stream(rows, W, layers=LAYERS, heads=HEADS, kv_heads=KV).collect()}
    x = np.sin(np.arange(n)[:, None] * np.arange(1, WIDTH + 1))
    assert np.allclose([got[p] for p in range(n)], K.backbone(x, W, LAYERS, HEADS, KV))


def batches_of(rows, schema, size):
    return pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema).to_batches(max_chunksize=size)


@pytest.mark.parametrize("size", [3, 1000])
def test_sequences_side_by_side(monkeypatch, size):
    """Lengths that differ, sequences that are read as they come, and caches that go to a file."""
    for name, value in (("SIDE_BY_SIDE", 20), ("LONG", 8), ("HELD_BYTES", 600)):
        monkeypatch.setattr(decode, name, value)
    x = {(s, b): rng.normal(size=(n, WIDTH)) for s, n in enumerate((3, 5, 3, 30, 1, 5, 7, 8)) for b in range(2)}
    rows = [(*k, p, v.tolist()) for k, seq in x.items() for p, v in enumerate(seq)]
    schema = pa.schema([("sample_id", pa.int64()), ("branch", pa.int64()), ("pos", pa.int64()), ("vec", pa.list_(pa.float64()))])
    got = [r for b in decode._decoded(iter(batches_of(rows, schema, size)), W, LAYERS, HEADS, KV, 4, 3) for r in b.to_pylist()]
    out = {(r["sample_id"], r["branch"], r["pos"]): r["out"] for r in got}
    assert len(got) == len(out) == len(rows)
    for k, seq in x.items():
        assert np.allclose([out[*k, p] for p in range(len(seq))], K.backbone(seq, W, LAYERS, HEADS, KV))


def test_loops_side_by_side(monkeypatch):
    monkeypatch.setattr(decode, "SIDE_BY_SIDE", 30)
    token, embed = head()
    x = {s: rng.normal(size=(3, n, WIDTH)) for s, n in enumerate((2, 5, 2, 5, 5, 2, 2))}
    rows = [(s, None, None, None, 1) for s in x] + [(s, b, p, v.tolist(), 1 + s % 2 if p == b == 0 else None) for s in x for b in range(3) for p, v in enumerate(x[s][b])]
    rows = sorted([*rows, (50, None, None, None, 2)], key=lambda r: [-1 if c is None else c for c in r[:3]])
    schema = pa.schema([("sample_id", pa.int64()), ("branch", pa.int64()), ("pos", pa.int64()), ("vec", pa.list_(pa.float64())), ("make", pa.int64())])
    got = {(r["sample_id"], r["step"]): r["token"] for b in decode._generated(iter(batches_of(rows, schema, 4)), W, LAYERS, HEADS, KV, token, embed, 2) for r in b.to_pylist()}
    assert sorted(got) == [(s, n) for s in x for n in range(2 + s % 2)]
    for s in x:
        assert np.allclose([got[s, n] for n in range(2 + s % 2)], by_hand(x[s], 2 + s % 2, s))


def test_a_table_needs_no_state_store(spark):
    """Keyed state cost a table several milliseconds and calls for each sequence."""
    rows = spark.createDataFrame([(1, 0, 0, [0.1] * WIDTH)], "sample_id long, branch long, pos long, vec array<double>")
    plan = decode.decode_stream(rows, W, layers=LAYERS, heads=HEADS, kv_heads=KV)._jdf.queryExecution().executedPlan().toString()
    assert "TransformWithState" not in plan and "MapInArrow" in plan
