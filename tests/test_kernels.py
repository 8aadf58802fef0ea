"""Numpy kernels against plain loops, and the tiny model against a step-by-step form."""

import numpy as np
import pytest

from tokenloom.operators import kernels as K
from tokenloom.plans import generation
from tokenloom.streaming.once import once

rng = np.random.default_rng(0)


def test_fresh_velocity_is_zero():
    w = K.init_weights(K.velocity_shapes(8, 6, 10, 3, 5), 1)
    x, t, c = rng.normal(size=(4, 8)), rng.random(4), rng.normal(size=(4, 6))
    assert np.array_equal(K.velocity_net(x, t, c, w, 3, 5), np.zeros((4, 8)))


def test_time_embedding_of_odd_width():
    e = K.timestep_embedding(np.array([0.0, 2.0]), 5)
    assert np.allclose(e[0], [1, 1, 0, 0, 0]) and np.allclose(e[1], [np.cos(2), np.cos(0.02), np.sin(2), np.sin(0.02), 0])


def test_conv_by_loops():
    x, k, b = rng.normal(size=(2, 5, 6)), rng.normal(size=(3, 2, 3, 3)), rng.normal(size=3)
    p = np.pad(x, ((0, 0), (1, 1), (1, 1)))
    want = np.array([[[(p[:, i : i + 3, j : j + 3] * k[o]).sum() + b[o] for j in range(6)] for i in range(5)] for o in range(3)])
    assert np.allclose(K.conv2d(x, k, b), want)
    assert K.downsample(rng.normal(size=(2, 8, 8)), {"d.w": rng.normal(size=(2, 2, 3, 3)), "d.b": np.zeros(2)}, "d").shape == (2, 4, 4)


def test_autoencoder_shapes():
    widths = [4, 8]
    enc = K.init_weights(K.autoencoder_shapes(3, 2, widths, False), 0, 0.2)
    dec = K.init_weights(K.autoencoder_shapes(3, 2, widths, True), 1, 0.2)
    moments = K.encoder(rng.normal(size=(3, 8, 8)), enc, 2, 2)
    assert moments.shape == (4, 4, 4)
    z = K.posterior(moments)
    assert np.array_equal(z, moments[:2]) and np.allclose(K.posterior(moments, np.zeros((2, 4, 4))), z)
    assert K.decoder(z, dec, 2, 2).shape == (3, 8, 8)


def test_cache_gives_the_same_states():
    w = K.init_weights(K.backbone_shapes(8, 2, 2, 1, 16), 3, 0.3)
    x = rng.normal(size=(6, 8))
    whole, cache = K.backbone(x, w, 2, 2, 1), {}
    parts = [K.backbone(x[a:b], w, 2, 2, 1, cache) for a, b in ((0, 3), (3, 4), (4, 6))]
    assert np.allclose(np.concatenate(parts), whole)


def test_rotation_keeps_the_norm():
    x = rng.normal(size=(5, 8))
    assert np.allclose(np.linalg.norm(K.rotate(x, np.arange(5)), axis=1), np.linalg.norm(x, axis=1))


def test_bicubic_grid():
    t = rng.normal(size=(16, 3))
    assert np.allclose(K.bicubic_grid(t, 4), t)
    assert np.allclose(K.bicubic_grid(np.ones((9, 1)), 7), 1)
    with pytest.raises(ValueError):
        K.bicubic_grid(np.ones((8, 1)), 4)


def test_weights_are_bounded():
    with pytest.raises(ValueError):
        K.check_size({"w": np.broadcast_to(np.zeros(1), (40_000_000,))})


def test_map_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 5.0])], "id long, v array<double>")
    got = {r["id"]: r["y"] for r in K.map_vectors(df, "v", "y", K.layer_norm).collect()}
    assert np.allclose(got[1], K.layer_norm(np.array([1.0, 2.0])))


def test_tiny_generation(spark):
    m = generation.TinyModel()
    w = m.weights()
    captions = spark.createDataFrame([(1, "a cat"), (2, "a dog on a mat")], "sample_id long, caption string")
    got = {(r["sample_id"], r["rep"]): r["latent"] for r in generation.generate(captions, m, repeats=2, positive="!", negative="bad", cfg=3.0, steps=3, schedule="linear", use_norm=True).collect()}
    import zlib

    for (sample, rep), latent in got.items():
        texts = [{1: "a cat", 2: "a dog on a mat"}[sample] + " !", "bad"]
        seqs = [w["embed"][[0, *[zlib.crc32(x.encode()) % m.vocabulary for x in t.split()]]] for t in texts]
        made = []
        for at in range(4):
            last = np.stack([K.backbone(s, w, 2, 2, 1)[-1] for s in seqs])  # no cache: everything again
            x = generation.sample_token(m, w, last, 1 + 2.0 * (4 - at) / 4, 1.0, 42, sample * 1000 + rep, at, 3)
            made.append(K.layer_norm(x))
            seqs = [np.concatenate([s, K.linear(made[-1][None], w, "image.in")]) for s in seqs]
        x = np.array(latent).reshape(4, 4, 4)
        for t in range(4):
            assert np.allclose(x[:, t // 2 * 2 : t // 2 * 2 + 2, t % 2 * 2 : t % 2 * 2 + 2].reshape(4, -1).ravel(), made[t])
    assert len(got) == 4


def test_log_once_in_a_stream(spark, tmp_path):
    rows = [("info", "a", "2024-01-01 00:00:00"), ("info", "a", "2024-01-01 00:00:01"), ("warn", "a", "2024-01-01 00:00:02")]
    spark.createDataFrame(rows, "level string, message string, ts string").selectExpr("level", "message", "cast(ts as timestamp) ts").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("level string, message string, ts timestamp").parquet(f"file://{tmp_path}/in")
    q = once(stream, ["level", "message"], "ts").writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 2


def test_images(spark):
    flat = np.full((9, 13, 3), 77, np.uint8)
    assert (K.resize_bicubic(flat, 4, 30) == 77).all()
    ramp = np.arange(16, dtype=float)[:, None, None].repeat(16, axis=1)
    assert np.allclose(K.resize_bicubic(ramp, 16, 16), ramp)
    assert np.allclose(K.box_halvings(ramp, 4)[:, 0, 0], [1.5, 5.5, 9.5, 13.5])
    odd = np.array([0.0, 10, 50, 100, 200])[:, None, None] * np.ones((5, 5, 1))
    assert np.allclose(K.box_halvings(odd, 2)[:, 0, 0], [20, 150])
    rows = spark.createDataFrame([("a", 40, 20, 1, [5] * 800), ("b", 16, 16, 3, list(range(256)) * 3)], "img_id string, h int, w int, ch int, data array<int>")
    got = {r["img_id"]: r for r in K.process_images(rows, "center", 16).collect()}
    assert set(got["a"]["data"]) == {5} and len(got["a"]["data"]) == 256
    assert got["b"]["data"] == list(range(256)) * 3
    padded = {r["img_id"]: r["data"] for r in K.crop_images(rows, 16, crop=False).collect()}
    assert padded["a"][0] == 0 and padded["a"][8] == 5
    for mode, size, error in (("original", 16, NotImplementedError), ("other", 16, ValueError), ("center", None, ValueError), ("center", 20, ValueError)):
        with pytest.raises(error):
            K.process_images(rows, mode, size)


def test_image_source(spark, tmp_path):
    import struct
    import zlib

    from tokenloom.sources import files

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes([10 * y, 20, 30 + x][i] for x in range(3) for i in range(3)) for y in range(2))
    (tmp_path / "x.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    (r,) = files.decoded_images(spark, f"file://{tmp_path}").collect()
    assert (r["h"], r["w"], r["ch"]) == (2, 3, 3)
    assert r["data"] == [v for y in range(2) for x in range(3) for v in (10 * y, 20, 30 + x)]
    assert files.binary_images(spark, f"file://{tmp_path}", "*.png").count() == 1


def test_http_source(spark, tmp_path):
    import functools
    import http.server
    import threading

    from tokenloom.sources import files

    (tmp_path / "a.bin").write_bytes(b"abc")
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path))
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(files.HttpFiles)
        url = f"http://127.0.0.1:{server.server_port}/a.bin"
        assert [(r["path"], bytes(r["content"])) for r in spark.read.format("http_files").option("urls", url).load().collect()] == [(url, b"abc")]
    finally:
        server.shutdown()
