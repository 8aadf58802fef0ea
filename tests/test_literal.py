"""Second layer: small, independently written Python models of the operators, and invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.functions import positions, text, vectors
from tokenloom.functions.ordering import global_index, running_before
from tokenloom.operators import attention, images, layout, losses, params, partition, prompts, sampler
from tokenloom.sources import files


def ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "k")


@pytest.mark.parametrize("n,r", [(0, 3), (1, 3), (2, 8), (5, 3), (7, 7), (16, 4), (23, 4), (23, 8)])
def test_no_pad(spark, n, r):
    got = {(x["rank"], x["slot"]): x["id"] for x in partition.no_pad(ids(spark, n), "k", r).collect()}
    want, start = {}, 0
    for rank in range(r):
        size = n // r + (rank < n % r)
        want |= {(rank, s): start + s for s in range(size)}
        start += size
    assert got == want


@pytest.mark.parametrize("n,r,rep", [(5, 3, 1), (7, 3, 2), (2, 4, 5)])
def test_repeat(spark, n, r, rep):
    shards, start = [], 0
    for rank in range(r):
        size = n // r + (rank < n % r)
        shards.append(list(range(start, start + size)))
        start += size
    rows = partition.repeat_no_pad(ids(spark, n), "k", r, rep).orderBy("rank", "turn", "slot").collect()
    for rank in range(r):
        assert [x["id"] for x in rows if x["rank"] == rank] == [i for t in range(rep) for i in shards[(rank + t) % r]]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 16, 23])
@pytest.mark.parametrize("r", [1, 3, 8])
@pytest.mark.parametrize("drop,skip", [(False, 0), (True, 0), (False, 1), (True, 99)])
def test_round_robin(spark, n, r, drop, skip):
    order = list(range(n))
    if drop and n % r:
        per = math.ceil((n - r) / r) if n >= r else 0
        order = order[: per * r]
    elif not drop and n:
        total = math.ceil(n / r) * r
        while len(order) < total:
            order += list(range(n))[: total - len(order)]
    want = sorted((order[p], p % r, p // r) for p in range(len(order)) if p // r >= skip)
    assert sorted(map(tuple, partition.round_robin(ids(spark, n), "k", r, shuffle=False, drop_last=drop, skip=skip).collect())) == want


def test_shuffles_differ_by_epoch_and_are_complete(spark):
    a = partition.round_robin(ids(spark, 50), "k", 4, epoch=0).collect()
    b = partition.round_robin(ids(spark, 50), "k", 4, epoch=1).collect()
    assert {x["id"] for x in a} == {x["id"] for x in b} == set(range(50)) and len(a) == 52
    assert sorted(map(tuple, a)) != sorted(map(tuple, b))


def test_global_index(spark):
    rng = random.Random(0)
    rows = [(rng.randrange(40), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, i long").withColumn("d", F.md5(F.col("i").cast("string").cast("binary")))
    got = global_index(df, ["k", "i"]).orderBy("idx").collect()
    assert [(x["k"], x["i"]) for x in got] == sorted(rows) and [x["idx"] for x in got] == list(range(500))
    got = global_index(df, ["d"]).orderBy("idx").collect()
    assert [x["d"] for x in got] == sorted(x["d"] for x in got) and [x["idx"] for x in got] == list(range(500))
    empty = df.limit(0)
    assert global_index(empty, ["k"]).count() == 0


def test_frequent_keys_spread_over_ranges(spark):
    """Nine rows of ten have one key, some have none: the order is complete, and no range holds nearly all."""
    rows = [(None if i % 50 == 0 else 7 if i % 10 else i, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    got = running_before(df, F.col("v"), ["k"], "before").collect()
    assert [x["k"] for x in sorted(got, key=lambda r: (r["before"], r["v"] > 0))] == sorted([k for k, _ in rows], key=lambda k: (k is not None, k))
    at = sorted((x["before"], x["v"]) for x in got)
    assert all(b + v == c for (b, v), (c, _) in zip(at, at[1:], strict=False))
    indexed = global_index(df, ["k"])
    assert sorted(x["idx"] for x in indexed.collect()) == list(range(3000))
    from tokenloom.functions.ordering import _ranged

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [x["count"] for x in _ranged(df, ["k"]).groupBy("_part").count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 0.6 * 3000


@pytest.mark.parametrize("c,h,w,p", [(16, 4, 4, 2), (4, 4, 4, 2), (4, 2, 8, 2), (1, 6, 3, 3), (3, 4, 4, 1)])
def test_patchify(spark, c, h, w, p):
    x = np.arange(c * h * w, dtype=float).reshape(c, h, w)
    want = x.reshape(c, h // p, p, w // p, p).transpose(1, 3, 0, 2, 4).reshape(-1, c * p * p)
    df = spark.createDataFrame([(1, x.ravel().tolist())], "id long, v array<double>")
    patches = layout.patchify(df, "v", c, h, w, p)
    got = {r["tok"]: r["vec"] for r in patches.collect()}
    assert np.array_equal(np.array([got[t] for t in range(len(got))]), want)
    back = layout.pack(layout.unpatchify(layout.patch_lanes(patches), "id", h, w, p), "id").collect()[0]["data"]
    assert back == x.ravel().tolist()


def test_substitution(spark):
    captions = [(3, "a <image> b"), (1, "<image><image>"), (2, "none"), (9, "end <image>")]
    sizes = [(i, 16 * (i + 1), 32) for i in range(4)]
    df = spark.createDataFrame(captions, "sample_id long, caption string")
    got = {r["sample_id"]: r["caption"] for r in prompts.substitute_images(df, spark.createDataFrame(sizes, "image_idx long, h long, w long")).collect()}
    k, want = 0, {}
    for i, c in sorted(captions):
        while prompts.MARKER in c:
            h, w = sizes[k][1] // 16, sizes[k][2] // 16
            c = c.replace(prompts.MARKER, f"{prompts.IMAGE_AREA}{h}*{w}{prompts.BEGIN_IMAGE}{prompts.PLACEHOLDER * (h * w)}{prompts.END_IMAGE}", 1)
            k += 1
        want[i] = c
    assert got == want
    assert {r["sample_id"]: r["markers"] for r in prompts.marker_violations(df).collect()} == {1: 2, 2: 0}


@pytest.mark.parametrize("cfg,img,n", [(1, 1, 1), (7.5, 1, 2), (7.5, 2, 3)])
def test_guidance_branches(spark, cfg, img, n):
    df = spark.createDataFrame([(1, "c", 32, 16)], "sample_id long, caption string, h int, w int")
    got = {r["branch"]: r["caption"] for r in prompts.guidance_captions(df, cfg=cfg, cfg_img=img, negative="n").collect()}
    image = f"{prompts.IMAGE_AREA}2*1{prompts.BEGIN_IMAGE}{prompts.PLACEHOLDER * 2}{prompts.END_IMAGE}n"
    assert got == {1: {0: "c"}, 2: {0: "c", 1: "n"}, 3: {0: "c", 1: image, 2: "n"}}[n]


@pytest.mark.parametrize("cfg,img", [(1, 2), (0.5, 1), (2, 0.5)])
def test_impossible_guidance(cfg, img):
    with pytest.raises(ValueError):
        prompts.guidance_branches(cfg, img)


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()[0]


def test_large_ints(spark):
    for v, s in ((0, "0"), (999, "999"), (1000, "1.0K"), (999950, "1000.0K"), (-1500, "-1.5K"), (10**15, "1.0P"), (2 * 10**18, "2000.0P"), (2_500_000, "2.5M")):
        assert one(spark, text.format_large_int(F.lit(v).cast("bigint")))[0] == s
    for s, v in (("1.5k", 1500), ("2B", 2 * 10**9), ("7", 7), ("1.2345K", 1234), ("3t", 3 * 10**12), ("-2M", -2 * 10**6), ("x", None)):
        assert one(spark, text.parse_large_int(F.lit(s)))[0] == v


def test_large_ints_round_as_printf(spark):
    rows = [v * sign * unit for unit in (1, 10**3, 10**6, 10**9, 10**12) for v in (1050, 1150, 1250, 1350, 6550, 9949, 9950, 12250, 12350, 999949, 999950) for sign in (1, -1) if v * unit < 10**18]
    got = spark.createDataFrame([(v,) for v in rows], "v long").select("v", text.format_large_int(F.col("v"))).collect()
    powers = ((3, "K"), (6, "M"), (9, "B"), (12, "T"), (15, "P"))
    for v, s in got:
        power, name = next((p, n) for p, n in powers if abs(v) < 10 ** (p + 3) or n == "P")
        assert s == f"{v / 10.0**power:.1f}{name}"


def test_text_helpers(spark):
    assert one(spark, text.matching_parenthesis(F.lit("f(a(b)c)d)"), F.lit(1)), text.matching_parenthesis(F.lit("f(a"), F.lit(1)), text.matching_parenthesis(F.lit("f(a)"), F.lit(0)))[:] == (7, None, None)
    assert one(spark, text.compare_versions(F.lit("2.10"), ">", F.lit("2.9")), text.compare_versions(F.lit("1.0"), "==", F.lit("1")), text.compare_versions(F.lit("1.2.3"), "<=", F.lit("1.2")))[:] == (True, True, False)
    with pytest.raises(ValueError):
        text.compare_versions(F.lit("1"), "~", F.lit("1"))
    assert one(spark, text.string_to_hw(text.hw_to_string(F.lit(9), F.lit(28))))[0] == [9, 28]
    seed = 0
    for a in (5, 123456789012, 7):
        seed = (seed * 31 + a) & 0x7FFFFFFF
    assert one(spark, text.make_seed(*[F.lit(a).cast("bigint") for a in (5, 123456789012, 7)]))[0] == seed


def test_left_pad(spark):
    df = spark.createDataFrame([(1, [5, 6]), (2, []), (3, [7])], "sample_id long, ids array<long>")
    got = {r["sample_id"]: (r["padded"], r["mask"]) for r in prompts.left_pad(df, "ids", 0, [9]).collect()}
    assert got == {1: ([5, 6, 9], [1, 1, 1]), 2: ([0, 0, 9], [0, 0, 1]), 3: ([0, 7, 9], [0, 1, 1])}


def vec(spark, values, fn):
    return np.array(spark.createDataFrame([(values,)], "v array<double>").select(fn(F.col("v")).alias("y")).collect()[0]["y"], float)


def test_vector_functions(spark):
    v = np.random.default_rng(0).normal(size=16)
    y = vec(spark, v.tolist(), vectors.layer_norm)
    assert abs(y.mean()) < 1e-9 and abs(y.var() - 1) < 1e-4
    assert abs((vec(spark, v.tolist(), vectors.rms_norm) ** 2).mean() - 1) < 1e-4
    e = np.exp(v - v.max())
    assert np.allclose(vec(spark, v.tolist(), vectors.softmax), e / e.sum())
    assert np.allclose(vec(spark, v.tolist(), vectors.rotate_half), np.concatenate([-v[8:], v[:8]]))
    r = vec(spark, v.tolist(), lambda c: positions.apply_rotary(c, F.lit(5)))
    assert np.isclose(np.linalg.norm(r), np.linalg.norm(v))
    assert np.isclose(vec(spark, v.tolist(), vectors.log_sum_exp), np.log(np.exp(v).sum()))


def test_attention_forms_agree(spark):
    rng = np.random.default_rng(1)
    rows = [(s, p, rng.normal(size=4).tolist()) for s in range(2) for p in range(7)]
    df = spark.createDataFrame(rows, "s long, p long, v array<double>")
    for causal in (True, False):
        a = {(r["s"], r["p"], r["d"]): r["out"] for r in attention.attention(df, "s", "p", "v", causal=causal).collect()}
        b = {(r["s"], r["p"]): r["out"] for r in attention.blocked_attention(df, "s", "p", "v", causal=causal, block=3).collect()}
        for s in range(2):
            x = np.array([v for t, _, v in rows if t == s])
            want = attention.attend(x, x, x, causal)
            for p in range(7):
                assert np.allclose([a[s, p, d] for d in range(4)], want[p]) and np.allclose(b[s, p], want[p])
            if causal:
                assert np.allclose(b[s, 0], x[0])
    q, k = rng.normal(size=4), rng.normal(size=(9, 4))
    whole = attention.attend(q[None], k, k, False)[0]
    assert np.allclose(attention.attend_stream(((k[i : i + 2] @ q / 2, k[i : i + 2]) for i in range(0, 9, 2))), whole)


def test_losses(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1), (0, [0.5, 0.1], -100), (0, [0.3, 0.3], 0), (0, [9.0, 9.0], None)], "s long, z array<double>, label int")
    r = losses.cross_entropy(df, "z", "label").collect()[0]
    want = (math.log(math.e + math.e**2) - 2 + math.log(2 * math.exp(0.3)) - 0.3) / 2
    assert r["n"] == 2 and math.isclose(r["loss"], want)
    masked = spark.createDataFrame([(1.0, 0), (2.0, 0)], "l double, m int")
    assert losses.masked_mean(masked, F.col("l"), F.col("m")).collect()[0]["loss"] == 0
    with pytest.raises(Exception, match="LM loss"):
        spark.range(1).select(losses.total_loss(F.lit(float("nan")), F.lit(1.0))).collect()


def test_state_diff(spark):
    schema = "name string, shape array<int>, dtype string, device string, data array<double>"
    base = ("w", [2], "f", "c", [1.0, 2.0])
    a = [("a", *base[1:]), ("b", *base[1:]), ("s", *base[1:]), ("t", *base[1:]), ("d", *base[1:]), ("v", *base[1:]), ("n", *base[1:])]
    b = [("c", *base[1:]), ("b", *base[1:]), ("s", [1, 2], "f", "c", [1.0, 2.0]), ("t", [2], "g", "c", [1.0, 2.0]), ("d", [2], "f", "x", [1.0, 2.0]), ("v", [2], "f", "c", [1.0, 2.1]), ("n", [2], "f", "c", [1.0, 2.0 + 1e-5])]
    got = {r["name"]: r["verdict"] for r in params.state_diff(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()}
    assert got == {"a": "only_first", "c": "only_second", "b": "same", "s": "shape", "t": "type", "d": "device", "v": "value", "n": "same"}
    sides = {r["name"]: r["side"] for r in params.key_differences(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()}
    assert sides == {"a": "first", "c": "second"}


def test_param_groups(spark):
    rows = [(0, "model.layers.3.w", [4, 2], True), (1, "model.layers.3.bias", [4], True), (2, "head", [3, 3], False), (3, "norm", [4], True), (4, "x", [2, 2], True)]
    df = spark.createDataFrame(rows, "ord int, name string, shape array<int>, requires_grad boolean")
    got = {(r["is_decayed"], round(r["lr_scale"], 6)): (r["names"], r["n"], r["weight_decay"]) for r in params.grouped(df, 1.0, 0.1, params.layer_scale).collect()}
    low = round(0.931**28, 6)
    assert got == {(True, low): (["model.layers.3.w"], 8, 0.1), (False, low): (["model.layers.3.bias"], 4, 0.0), (False, 1.0): (["norm"], 4, 0.0), (True, 1.0): (["x"], 4, 0.1)}
    listed = params.grouped(df, 1.0, 0.1, None, ["norm"]).collect()
    assert {r["is_decayed"]: r["names"] for r in listed} == {True: ["norm"], False: ["model.layers.3.w", "model.layers.3.bias", "x"]}
    empty = spark.createDataFrame([(None,)], "g array<double>")
    assert params.grad_norm(empty, "g").collect()[0]["norm"] == 0


def test_sampler(spark):
    n, last = 6, 0.04
    t = np.linspace(0, 1 - last, n)
    t = t / (3.2 - 2.2 * t)
    assert np.allclose([r["t"] for r in sampler.timesteps(spark, n, shift=3.2).orderBy("i").collect()], t)
    x = 0.7
    for k in range(n - 1):
        v, dt = 0.3 - x, t[k + 1] - t[k]
        x = x + (v + (1 - t[k]) * ((t[k] * v - x) / (1 - t[k]))) * dt + math.sqrt(2 * (1 - t[k])) * 0.5 * (k + 1) * math.sqrt(dt)
    x += (0.3 - x) * last
    got = one(spark, sampler.euler(F.lit(0.7), lambda x, _: 0.3 - x, lambda k: 0.5 * (k + 1), steps=n, shift=3.2))[0]
    assert math.isclose(got, x)
    with pytest.raises(ValueError):
        sampler.timesteps(spark, 1)
    with pytest.raises(NotImplementedError):
        sampler.guidance_scale(F.lit(0), 4, 2.0, "cosine")
    assert one(spark, sampler.guided([F.lit(3.0), F.lit(9.0)], 1.0, 1.0))[0] == 3.0


def test_pixels(spark):
    x = [0.0, 0.5, 127.5, 254.4, 255.0]
    df = spark.createDataFrame([(x,)], "d array<double>")
    eleven = images.convert(F.col("d"), F.lit("255"), "11")
    back = df.select(images.convert(eleven, F.lit("11"), "255").alias("y")).collect()[0]["y"]
    assert back == [float(np.round(v)) for v in x]
    assert one(spark, images.guess_range(F.array(F.lit(0.1), F.lit(-0.1)), "float32"), images.guess_range(F.array(F.lit(0.1)), "float16"), images.guess_range(F.array(F.lit(1.0)), "uint8"))[:] == ("11", "01", "255")
    with pytest.raises(TypeError):
        images.guess_range(F.lit(1), "int64")
    with pytest.raises(Exception, match="not an image"):
        spark.range(1).select(images.assert_image(F.lit(1), F.lit(1), F.lit(2), F.array(F.lit(1.0), F.lit(1.0)))).collect()
    for h, w, size in ((101, 333, 25), (64, 64, 64), (40, 30, 50), (1000, 77, 9)):
        a, b, n = h, w, 0
        while min(a, b) >= 2 * size:
            a, b, n = a // 2, b // 2, n + 1
        s = size / min(a, b)
        assert tuple(one(spark, images.resize_dims(F.lit(h), F.lit(w), F.lit(size)))[0]) == (n, round(a * s), round(b * s))


def test_final_names(spark):
    wanted = spark.createDataFrame([(1, "a/x.png"), (2, "a/x.png"), (3, "a/y.jpg"), (4, "a/x.png"), (5, "b.c/z")], "id long, path string")
    taken = spark.createDataFrame([("a/x.png",), ("a/x_1.png",), ("a/y_0.jpg",)], "path string")
    got = {r["id"]: r["name"] for r in files.final_names(wanted, taken).collect()}
    assert got == {1: "a/x_0.png", 2: "a/x_2.png", 4: "a/x_3.png", 3: "a/y.jpg", 5: "b.c/z"}
    rng = random.Random(3)
    paths = [rng.choice(["a.jpg", "a_0.jpg", "a_0_0.jpg", "a_1.jpg", "a_01.jpg", "b", "b_2", "d.x/a.jpg"]) for _ in range(60)]
    there = ["a_2.jpg", "b", "a_0_1.jpg", "a_03.jpg"]
    got = {r["id"]: r["name"] for r in files.final_names(spark.createDataFrame(list(enumerate(paths)), "id long, path string"), spark.createDataFrame([(p,) for p in there], "path string")).collect()}
    assert len(set(got.values()) | set(there)) == 64
    seen, reserved = set(), {*there, *paths}
    for i, p in enumerate(paths):  # one after the other
        want = p
        if p in there or p in seen:
            root, dot, ext = p.rpartition(".") if p.endswith(".jpg") else (p, "", "")
            want = next(n for n in (f"{root}_{k}{dot}{ext}" for k in range(100)) if n not in reserved and n not in seen)
        seen.add(want)
        assert got[i] == want


def test_config(spark, tmp_path):
    (tmp_path / "config.json").write_text('{\n "a": 1,\n "b": "x",\n "z": null\n}')
    got = {r["key"]: r["value"] for r in files.load_config(spark, f"file://{tmp_path}/config.json", ["a", "b", "c"], {"b": "y", "c": "new", "q": "no"}).collect()}
    assert got == {"a": "1", "b": "y", "c": "new"}
