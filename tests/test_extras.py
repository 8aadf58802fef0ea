import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.operators import modules, permutation, training
from tokenloom.plans import extras
from tokenloom.sources import image_sink


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 16, 17, 100, 1000, 1025])
def test_permutation_is_a_bijection(spark, n):
    rows = spark.range(n).select("id", *[permutation.permuted(F.col("id"), n, k).alias(k) for k in ("a", "b")]).collect()
    for k in ("a", "b"):
        assert sorted(r[k] for r in rows) == list(range(n))
    if n >= 100:
        assert [r["a"] for r in rows] != [r["b"] for r in rows]
        moved = np.array([r["a"] for r in rows])
        assert abs(np.corrcoef(np.arange(n), moved)[0, 1]) < 0.3 and (moved == np.arange(n)).sum() < 10


@pytest.mark.parametrize("n,ranks,drop,skip", [(23, 4, False, 0), (23, 4, True, 2), (3, 8, False, 0), (3, 8, True, 0), (16, 4, False, 1), (1, 1, False, 0)])
def test_ranks_of_a_permuted_order(spark, n, ranks, drop, skip):
    rows = permutation.numbered(spark.createDataFrame([(10 * i,) for i in range(n)], "k long"), "k")
    got = [tuple(r) for r in permutation.permuted_ranks(rows, n, ranks, seed=3, epoch=1, drop_last=drop, skip=skip).collect()]
    place = {r["i"]: r["p"] for r in spark.range(n).select(F.col("id").alias("i"), permutation.permuted(F.col("id"), n, "3:1").alias("p")).collect()}
    order = [10 * i for i in sorted(place, key=place.get)]
    total = n // ranks * ranks if drop else -(-n // ranks) * ranks
    want = [(order[p % n], p % ranks, p // ranks) for p in range(total) if p // ranks >= skip]
    assert sorted(got) == sorted(want)
    parts = [permutation.permuted_ranks(rows.where(F.col("id") % 20 == m), n, ranks, seed=3, epoch=1, drop_last=drop, skip=skip) for m in (0, 10)]
    assert sorted(tuple(r) for p in parts for r in p.collect()) == sorted(want)  # rows are placed one by one


def test_a_resumed_epoch_shuffles_nothing(spark):
    rows = spark.range(50).select("id", F.col("id").alias("idx"))
    plan = permutation.permuted_ranks(rows, 50, 4, skip=3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


TREE = [(1, None, "model", "Norm"), (2, 1, "embed", "Embedding"), (3, 1, "layers", "List"), (4, 3, "0", "Layer"), (5, 4, "norm", "Norm"), (6, 5, "deep", "Linear"), (7, 4, "mlp", "Linear")]
PARAMS = [(1, "scale"), (2, "weight"), (5, "weight"), (6, "weight"), (7, "weight"), (7, "bias")]


def tree(spark, rows):
    return spark.createDataFrame(rows, "id long, parent long, name string, type string")


def test_module_names(spark):
    params = spark.createDataFrame(PARAMS, "module long, name string")
    names = lambda df: sorted(r["name"] for r in df.collect())
    assert names(modules.parameter_names(tree(spark, TREE), params)) == ["embed.weight", "layers.0.mlp.bias", "layers.0.mlp.weight", "layers.0.norm.deep.weight", "layers.0.norm.weight", "scale"]
    assert names(modules.decay_names(tree(spark, TREE), params, ["Norm"])) == ["embed.weight", "layers.0.mlp.weight", "scale"]  # the root's type does not count
    deep = tree(spark, [(0, None, "r", "M"), *[(i, i - 1, "c", "M") for i in range(1, 40)]])
    assert max(len(r["path"].split(".")) for r in modules.module_paths(deep).collect()) == 39
    assert modules.module_paths(tree(spark, [])).count() == 0


@pytest.mark.parametrize("rows", [[(1, 2, "a", "M"), (2, 1, "b", "M")], [(1, 1, "a", "M")], [(0, None, "r", "M"), *[(i, i % 5 + 1, "c", "M") for i in range(1, 6)]], [(1, None, "a", "M"), (1, None, "a", "M")], [(1, 9, "a", "M")]])
def test_no_tree(spark, rows):
    with pytest.raises(ValueError, match="contain each other|must differ"):
        modules.module_paths(tree(spark, rows))


def unpacked(raw):
    """A PNG read by hand: only what the encoder writes."""
    assert raw[:8] == image_sink.SIGNATURE
    at, chunks = 8, {}
    while at < len(raw):
        (n,) = struct.unpack_from(">I", raw, at)
        kind, body = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n]
        assert struct.unpack_from(">I", raw, at + 8 + n)[0] == zlib.crc32(kind + body)
        chunks[kind] = body
        at += 12 + n
    w, h, depth, colour = struct.unpack_from(">IIBB", chunks[b"IHDR"])
    ch = {v: k for k, v in image_sink.COLOUR.items()}[colour]
    lines = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), np.uint8).reshape(h, -1)
    assert depth == 8 and (lines[:, 0] == 1).all()
    return np.cumsum(lines[:, 1:].reshape(h, w, ch), axis=1, dtype=np.uint8)


@pytest.mark.parametrize("ch", [1, 2, 3, 4])
def test_png(ch):
    x = np.random.default_rng(ch).integers(0, 256, (5, 7, ch)).astype(np.uint8)
    assert np.array_equal(unpacked(image_sink.png(x)), x)
    with pytest.raises(ValueError, match="shape"):
        image_sink.png(x[:0])


def test_images_are_read_back_by_spark(spark, tmp_path):
    from tokenloom.sources.files import decoded_images

    x = np.random.default_rng(0).integers(0, 256, (4, 6, 3))
    rows = [(5, "a.png", 4, 6, 3, x.ravel().tolist()), (2, "a.png", 1, 1, 3, [1, 2, 3]), (9, "b.ppm", 1, 2, 3, [9] * 6)]
    names = image_sink.save_images(spark.createDataFrame(rows, "id long, path string, h int, w int, ch int, data array<int>").repartition(3), f"file://{tmp_path}/out")
    assert {r["id"]: r["name"] for r in names.collect()} == {2: "a.png", 5: "a_0.png", 9: "b.ppm"}
    assert sorted(os.listdir(tmp_path / "out")) == ["a.png", "a_0.png", "b.ppm"]
    got = {os.path.basename(r["img_id"]): r for r in decoded_images(spark, f"file://{tmp_path}/out").collect()}
    assert got["a_0.png"]["data"] == x.ravel().tolist() and (got["a_0.png"]["h"], got["a_0.png"]["w"], got["a_0.png"]["ch"]) == (4, 6, 3)
    again = image_sink.save_images(spark.createDataFrame(rows[:1], "id long, path string, h int, w int, ch int, data array<int>"), f"file://{tmp_path}/out")
    assert os.path.exists(tmp_path / "out" / "a_1.png") and len(os.listdir(tmp_path / "out")) == 4 and again.columns == ["id", "path", "name"]


@pytest.mark.parametrize("bad", [("c.png", 2, 2, 1, [1, 2, 3]), ("c.gif", 1, 1, 1, [1]), ("c.png", 1, 1, 1, [256]), ("../c.png", 1, 1, 1, [1])])
def test_a_failed_task_leaves_no_file(spark, tmp_path, bad):
    rows = spark.createDataFrame([(1, "good.png", 1, 1, 1, [7]), (2, *bad)], "id long, path string, h int, w int, ch int, data array<int>").repartition(2)
    with pytest.raises(Exception, match="fill|encoder|no name"):
        image_sink.save_images(rows, f"{tmp_path}/out")
    assert not os.path.exists(tmp_path / "out") or os.listdir(tmp_path / "out") == []


def loss(spark, positions, patches, masks, **options):
    p = spark.createDataFrame(positions, "sample_id long, pos long, token_id long, label long, hidden array<double>")
    q = spark.createDataFrame(patches, "sample_id long, place long, target array<double>")
    m = spark.createDataFrame(masks, "sample_id long, mask int")
    return training.training_loss(p, q, m, placeholder=99, logits=lambda h: h, velocity=lambda x, t, h: h, **options).collect()[0]


def test_training_loss_routes_positions(spark):
    positions = [(1, 0, 5, 5, [1.0, 2.0]), (1, 1, 99, -100, [3.0, 0.0]), (1, 2, 99, -100, [0.5, 0.5]), (1, 3, 7, 1, [4.0, 4.0])]
    r = loss(spark, positions, [(1, 0, [1.0, 1.0]), (1, 1, [2.0, 2.0])], [(1, 1)])
    want = np.log(np.exp(0.5) * 2) - 0.5  # only position 2 asks for a word: that of position 3, label 1
    assert np.isclose(r["lm_loss"], want) and (r["n_tokens"], r["n_patches"]) == (1, 2)
    assert np.isclose(r["loss"], 0.01 * want + r["im_loss"]) and r["im_loss"] > 0
    off = loss(spark, positions, [(1, 0, [1.0, 1.0]), (1, 1, [2.0, 2.0])], [(1, 0)])
    assert off["im_loss"] == 0
    assert loss(spark, positions, [(1, 0, [1.0, 1.0])], [], image_weight=0.0)["im_loss"] == 0


def test_training_loss_guards(spark):
    text = [(1, 0, 5, 0, [1.0, 2.0]), (1, 1, 6, 1, [1.0, 2.0])]
    assert loss(spark, text, [], [])["im_loss"] == 0
    with pytest.raises(Exception, match="differ in number"):
        loss(spark, text, [(1, 0, [1.0, 1.0])], [(1, 1)])
    with pytest.raises(Exception, match="LM loss is"):
        loss(spark, [(1, 0, 5, 0, [1.0, 2.0])], [], [])
    with pytest.raises(Exception, match="LM loss is"):
        loss(spark, [(1, 0, 5, 0, [float("inf"), 2.0]), (1, 1, 6, 1, [1.0, 2.0])], [], [])


def test_pixels_are_taken_apart_after_the_join(spark, sf):
    """Sorting and joining a row a pixel took memory by the number of pixels."""
    lines = extras.image_files(spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert next(i for i, line in enumerate(lines) if "posexplode" in line) < next(i for i, line in enumerate(lines) if "Join" in line)
