"""Registered queries of the network layers: numpy kernels on one side, the same layers as SQL over long tables on the other.

Weights come from a formula, so both sides have them.  A relation of activations is (id, i, v).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.operators import images
from tokenloom.operators import kernels as K
from tokenloom.plans.queries import CELLS, latents, q6, query, r6

# ---------------------------------------------------------------- weights by formula


def weight(*shape: int, salt: int) -> np.ndarray:
    """(out, in) or (out, in, y, x): ((31 out + 17 in + 5 y + 3 x + 7 salt) mod 23 - 11) / 40."""
    at = np.indices(shape)
    return ((np.tensordot((31, 17, 5, 3)[: len(shape)], at, 1) + 7 * salt) % 23 - 11) / 40.0


def bias(n: int, salt: int) -> np.ndarray:
    return ((13 * np.arange(n) + 5 * salt) % 7 - 3) / 10.0


def _w(out: str, inner: str, salt: int, more: str = "0") -> str:
    return f"(((31 * ({out}) + 17 * ({inner}) + {more} + {7 * salt}) % 23 - 11) / 40.0)"


def _b(out: str, salt: int) -> str:
    return f"(((13 * ({out}) + {5 * salt}) % 7 - 3) / 10.0)"


# ---------------------------------------------------------------- layers as SQL


def _x(name: str, first: int, n: int) -> str:
    return f"{name} AS (SELECT vec_id AS id, i - {first} AS i, v FROM cells WHERE i BETWEEN {first} AND {first + n - 1})"


def _linear(dst: str, src: str, n: int, salt: int, with_bias: bool = True) -> str:
    b = f" + {_b('o', salt)}" if with_bias else ""
    return f"{dst} AS (SELECT id, o AS i, sum(v * {_w('o', 'i', salt)}){b} AS v FROM {src}, range({n}) t(o) GROUP BY id, o)"


def _map(dst: str, src: str, expr: str) -> str:
    return f"{dst} AS (SELECT id, i, {expr} AS v FROM {src})"


def _both(dst: str, a: str, b: str, expr: str) -> str:
    """``expr`` of x.v and y.v."""
    return f"{dst} AS (SELECT id, i, {expr} AS v FROM {a} x JOIN {b} y USING (id, i))"


def _layer_norm(dst: str, src: str, by: str = "id") -> str:
    return f"{dst} AS (SELECT id, i, (v - avg(v) OVER w) / sqrt(avg(v * v) OVER w - avg(v) OVER w * avg(v) OVER w + 1e-6) AS v FROM {src} WINDOW w AS (PARTITION BY {by}))"


def _part(dst: str, src: str, first: int, n: int) -> str:
    return f"{dst} AS (SELECT id, i - {first} AS i, v FROM {src} WHERE i BETWEEN {first} AND {first + n - 1})"


SILU = "v / (1 + exp(-v))"


def _sql(*ctes: str, last: str) -> str:
    return f"WITH {CELLS}, {', '.join(ctes)} SELECT id AS vec_id, i, {q6('v')} AS y FROM {last}"


def _rows(df: DataFrame, fn) -> DataFrame:
    """vec_id, i, y: ``fn`` (rows x width -> rows x width') of the vectors v."""
    out = K.map_vectors(df.select("vec_id", "v"), "v", "out", fn)
    return out.select("vec_id", F.posexplode("out").alias("i", "y")).select("vec_id", "i", r6(F.col("y")).alias("y"))


# ---------------------------------------------------------------- dense layers


@query(_sql(_x("x", 0, 64), _linear("y", "x", 16, 1), last="y"))
def linear_projection(spark, sf):
    w = {"p.w": weight(16, 64, salt=1), "p.b": bias(16, 1)}
    return _rows(latents(spark, sf), lambda v: K.linear(v, w, "p"))


@query(_sql(_x("x", 0, 64), _linear("g", "x", 12, 2, False), _map("gs", "g", SILU), _linear("u", "x", 12, 3, False), _both("h", "gs", "u", "x.v * y.v"), _linear("y", "h", 64, 4, False), last="y"))
def gated_mlp(spark, sf):
    w = {"m.gate.w": weight(12, 64, salt=2), "m.up.w": weight(12, 64, salt=3), "m.down.w": weight(64, 12, salt=4)}
    return _rows(latents(spark, sf), lambda v: K.gated_mlp(v, w, "m"))


_MODULATED = _both("n1", "n0", "scale", "x.v * (1 + y.v)"), _both("n2", "n1", "shift", "x.v + y.v")


@query(
    _sql(
        _x("x", 0, 32), _x("c", 32, 32), _map("cs", "c", SILU), _linear("mod", "cs", 96, 5), _part("shift", "mod", 0, 32), _part("scale", "mod", 32, 32), _part("gate", "mod", 64, 32),
        _layer_norm("n", "x"), _map("n0", "n", f"v * (1 + {_b('i', 6)}) + {_b('i', 7)}"), *_MODULATED, _linear("h1", "n2", 32, 8), _map("h2", "h1", SILU), _linear("h3", "h2", 32, 9),
        _both("h4", "h3", "gate", "x.v * y.v"), _both("y", "x", "h4", "x.v + y.v"), last="y",
    )
)
def residual_block(spark, sf):
    w = {"r.mod.w": weight(96, 32, salt=5), "r.mod.b": bias(96, 5), "r.norm.w": 1 + bias(32, 6), "r.norm.b": bias(32, 7), "r.in.w": weight(32, 32, salt=8), "r.in.b": bias(32, 8), "r.out.w": weight(32, 32, salt=9), "r.out.b": bias(32, 9)}
    return _rows(latents(spark, sf), lambda v: K.residual_block(v[:, :32], v[:, 32:], w, "r"))


@query(_sql(_x("x", 0, 32), _x("c", 32, 32), _map("cs", "c", SILU), _linear("mod", "cs", 64, 10), _part("shift", "mod", 0, 32), _part("scale", "mod", 32, 32), _layer_norm("n0", "x"), *_MODULATED, _linear("y", "n2", 8, 11), last="y"))
def final_layer(spark, sf):
    w = {"final.mod.w": weight(64, 32, salt=10), "final.mod.b": bias(64, 10), "final.out.w": weight(8, 32, salt=11), "final.out.b": bias(8, 11)}
    return _rows(latents(spark, sf), lambda v: K.final_layer(v[:, :32], v[:, 32:], w))


def _time(t: str, dim: int) -> str:
    half = dim // 2
    return f"tm AS (SELECT vec_id AS id, k AS i, CASE WHEN k < {half} THEN cos({t} * exp(-ln(10000.0) * k / {half})) ELSE sin({t} * exp(-ln(10000.0) * (k - {half}) / {half})) END AS v FROM embeddings, range({dim}) r(k))"


_TIME_MLP = _time("vec_id / 500.0", 6), _linear("t1", "tm", 12, 12), _map("t2", "t1", SILU), _linear("t3", "t2", 12, 13)
_TIME_WEIGHTS = {"time.in.w": weight(12, 6, salt=12), "time.in.b": bias(12, 12), "time.out.w": weight(12, 12, salt=13), "time.out.b": bias(12, 13)}


@query(_sql(*_TIME_MLP, last="t3"))
def time_mlp(spark, sf):
    rows = latents(spark, sf).select("vec_id", F.array(F.col("vec_id") / 500.0).alias("v"))
    return _rows(rows, lambda v: K.time_embed(v[:, 0], _TIME_WEIGHTS, 6))


@query(
    _sql(
        _x("x", 0, 40), _x("c", 40, 24), *_TIME_MLP, _linear("cond", "c", 12, 14), _both("e", "t3", "cond", "x.v + y.v"), _linear("h", "x", 12, 15), _map("es", "e", SILU),
        _linear("bmod", "es", 36, 16), _part("bshift", "bmod", 0, 12), _part("bscale", "bmod", 12, 12), _part("bgate", "bmod", 24, 12), _layer_norm("bn", "h"),
        _both("b1", "bn", "bscale", "x.v * (1 + y.v)"), _both("b2", "b1", "bshift", "x.v + y.v"), _linear("b3", "b2", 12, 17), _map("b4", "b3", SILU), _linear("b5", "b4", 12, 18),
        _both("b6", "b5", "bgate", "x.v * y.v"), _both("b", "h", "b6", "x.v + y.v"),
        _linear("mod", "es", 24, 19), _part("shift", "mod", 0, 12), _part("scale", "mod", 12, 12), _layer_norm("n0", "b"), *_MODULATED, _linear("y", "n2", 40, 20), last="y",
    )
)
def velocity_net(spark, sf):
    """Noisy tokens, times and conditions through one residual block: the whole flow head at small width."""
    w = _TIME_WEIGHTS | {"proj.w": weight(12, 40, salt=15), "proj.b": bias(12, 15), "cond.w": weight(12, 24, salt=14), "cond.b": bias(12, 14)}
    w |= {"block0.norm.w": np.ones(12), "block0.norm.b": np.zeros(12), "block0.mod.w": weight(36, 12, salt=16), "block0.mod.b": bias(36, 16), "block0.in.w": weight(12, 12, salt=17), "block0.in.b": bias(12, 17), "block0.out.w": weight(12, 12, salt=18), "block0.out.b": bias(12, 18)}
    w |= {"final.mod.w": weight(24, 12, salt=19), "final.mod.b": bias(24, 19), "final.out.w": weight(40, 12, salt=20), "final.out.b": bias(40, 20)}
    rows = latents(spark, sf).select("vec_id", F.concat("v", F.array(F.col("vec_id") / 500.0)).alias("v"))
    return _rows(rows, lambda v: K.velocity_net(v[:, :40], v[:, 64], v[:, 40:64], w, 1, 6))


# ---------------------------------------------------------------- transformer

_HEADS, _WIDTH, _LONG = 2, 8, 8


def _rms(dst: str, src: str, salt: int) -> str:
    return f"{dst} AS (SELECT id, i, v / sqrt(avg(v * v) OVER (PARTITION BY id) + 1e-6) * (1 + {_b('i', salt)}) AS v FROM {src})"


def _rotated(dst: str, src: str, long: int = _LONG) -> str:
    """Heads of four, halves of two; the position is id % ``long``."""
    angle = f"((id % {long}) * power(10000.0, -(i % 2) / 2.0))"
    other = "CASE WHEN a.i % 4 < 2 THEN -b.v ELSE b.v END"
    return f"{dst} AS (SELECT a.id, a.i, a.v * cos(a.angle) + {other} * sin(a.angle) AS v FROM (SELECT *, {angle} AS angle FROM {src}) a JOIN {src} b ON a.id = b.id AND b.i = a.i // 4 * 4 + (a.i % 4 + 2) % 4)"


def _decoder(salt: int, x: str, y: str, long: int = _LONG, tag: str = "") -> list[str]:
    p = f"L{tag}{salt}"
    return [
        _rms(f"{p}n", x, salt), _linear(f"{p}q0", f"{p}n", 8, salt + 1, False), _linear(f"{p}k0", f"{p}n", 4, salt + 2, False), _linear(f"{p}v", f"{p}n", 4, salt + 3, False), _rotated(f"{p}q", f"{p}q0", long), _rotated(f"{p}k", f"{p}k0", long),
        f"{p}s AS (SELECT q.id, k.id AS kid, q.i // 4 AS h, sum(q.v * k.v) / 2 AS s FROM {p}q q JOIN {p}k k ON q.id // {long} = k.id // {long} AND k.id <= q.id AND k.i = q.i % 4 GROUP BY ALL)",
        f"{p}p AS (SELECT *, exp(s - max(s) OVER w) / sum(exp(s)) OVER w * exp(max(s) OVER w) AS p FROM {p}s WINDOW w AS (PARTITION BY id, h))",
        f"{p}a AS (SELECT p.id, p.h * 4 + v.i AS i, sum(p.p * v.v) AS v FROM {p}p p JOIN {p}v v ON v.id = p.kid GROUP BY ALL)",
        _linear(f"{p}o", f"{p}a", 8, salt + 4, False), _both(f"{p}x", x, f"{p}o", "x.v + y.v"), _rms(f"{p}m", f"{p}x", salt + 5),
        _linear(f"{p}g", f"{p}m", 16, salt + 6, False), _map(f"{p}gs", f"{p}g", SILU), _linear(f"{p}u", f"{p}m", 16, salt + 7, False), _both(f"{p}h", f"{p}gs", f"{p}u", "x.v * y.v"), _linear(f"{p}d", f"{p}h", 8, salt + 8, False),
        _both(y, f"{p}x", f"{p}d", "x.v + y.v"),
    ]


def _decoder_weights(name: str, salt: int) -> K.Weights:
    shapes = {"q": (8, 8), "k": (4, 8), "v": (4, 8), "o": (8, 8)}
    w = {f"{name}.norm1.w": 1 + bias(8, salt), f"{name}.norm2.w": 1 + bias(8, salt + 5), f"{name}.mlp.gate.w": weight(16, 8, salt=salt + 6), f"{name}.mlp.up.w": weight(16, 8, salt=salt + 7), f"{name}.mlp.down.w": weight(8, 16, salt=salt + 8)}
    return w | {f"{name}.{k}.w": weight(*s, salt=salt + 1 + n) for n, (k, s) in enumerate(shapes.items())}


def _sequences(spark, sf, fn) -> DataFrame:
    """A vector is a sequence of eight tokens of eight entries: nothing is brought together."""
    return _rows(latents(spark, sf), lambda v: np.stack([fn(x.reshape(_LONG, _WIDTH)).ravel() for x in v]))


def _tokens_sql(*ctes: str) -> str:
    x = f"x AS (SELECT vec_id * {_LONG} + i // {_WIDTH} AS id, i % {_WIDTH} AS i, v FROM cells)"
    return f"WITH {CELLS}, {x}, {', '.join(ctes)} SELECT id // {_LONG} AS vec_id, id % {_LONG} * {_WIDTH} + i AS i, {q6('v')} AS y FROM y"


@query(_tokens_sql(*_decoder(21, "x", "y")))
def decoder_layer(spark, sf):
    w = _decoder_weights("layer0", 21)
    return _sequences(spark, sf, lambda x: K.decoder_layer(x, w, "layer0", _HEADS, 1))


@query(_tokens_sql(*_decoder(21, "x", "x1"), *_decoder(30, "x1", "x2"), _rms("y", "x2", 39)))
def backbone(spark, sf):
    w = _decoder_weights("layer0", 21) | _decoder_weights("layer1", 30) | {"norm.w": 1 + bias(8, 39)}
    return _sequences(spark, sf, lambda x: K.backbone(x, w, 2, _HEADS, 1))


# ---------------------------------------------------------------- convolutions: a latent is 4 channels of 4 x 4


def _conv(dst: str, src: str, n: int, salt: int, side: int = 4, stride: int = 1, top: int = 1) -> str:
    """3 x 3, padded on top and left by ``top``; the result has side / stride pixels a side."""
    out = side // stride
    place = f"(o.p // {out} * {stride} + dy - {top})", f"(o.p % {out} * {stride} + dx - {top})"
    kernel = _w("c", f"(x.i // {side * side})", salt, "5 * dy + 3 * dx")
    pixels = f"(SELECT c, p FROM range({n}) a(c), range({out * out}) b(p)) o, range(3) y(dy), range(3) z(dx)"
    taken = f"{dst}s AS (SELECT x.id, c * {out * out} + p AS i, sum(x.v * {kernel}) AS v FROM {src} x, {pixels} WHERE x.i % {side * side} // {side} = {place[0]} AND x.i % {side} = {place[1]} GROUP BY ALL)"
    return f"{taken}, {dst} AS (SELECT id, i, v + {_b(f'i // {out * out}', salt)} AS v FROM {dst}s)"


def _group_norm(dst: str, src: str, groups: int, channels: int, salt: int) -> list[str]:
    inside = f"i // {channels * 16 // groups}"
    return [_layer_norm(f"{dst}n", src, f"id, {inside}"), _map(dst, f"{dst}n", f"v * (1 + {_b('i // 16', salt)}) + {_b('i // 16', salt + 1)}")]


def _image(fn):
    return lambda v: np.stack([fn(x.reshape(4, 4, 4)).ravel() for x in v])


@query(_sql(_x("x", 0, 64), _conv("y", "x", 3, 40), last="y"))
def conv3x3(spark, sf):
    k, b = weight(3, 4, 3, 3, salt=40), bias(3, 40)
    return _rows(latents(spark, sf), _image(lambda x: K.conv2d(x, k, b)))


@query(_sql(_x("x", 0, 64), _conv("y", "x", 4, 41, 4, 2, 0), last="y"))
def conv_downsample(spark, sf):
    w = {"d.w": weight(4, 4, 3, 3, salt=41), "d.b": bias(4, 41)}
    return _rows(latents(spark, sf), _image(lambda x: K.downsample(x, w, "d")))


def _resnet_weights(name: str, salt: int) -> K.Weights:
    w = {f"{name}.norm{k}.w": 1 + bias(4, salt + 3 * k) for k in (1, 2)} | {f"{name}.norm{k}.b": bias(4, salt + 3 * k + 1) for k in (1, 2)}
    return w | {f"{name}.conv{k}.w": weight(4, 4, 3, 3, salt=salt + 3 * k + 2) for k in (1, 2)} | {f"{name}.conv{k}.b": bias(4, salt + 3 * k + 2) for k in (1, 2)}


def _resnet(x: str, y: str, salt: int) -> list[str]:
    p, out, src = f"R{salt}", [], x
    for k in (1, 2):
        out += [*_group_norm(f"{p}g{k}", src, 2, 4, salt + 3 * k), _map(f"{p}s{k}", f"{p}g{k}", SILU), _conv(f"{p}c{k}", f"{p}s{k}", 4, salt + 3 * k + 2)]
        src = f"{p}c{k}"
    return [*out, _both(y, x, src, "x.v + y.v")]


@query(_sql(_x("x", 0, 64), *_resnet("x", "y", 42), last="y"))
def resnet_block(spark, sf):
    w = _resnet_weights("r", 42)
    return _rows(latents(spark, sf), _image(lambda x: K.resnet_block(x, w, "r", 2)))


def _pixels(dst: str, src: str) -> str:
    """Channels of each pixel as a row of its own: id * 16 + pixel."""
    return f"{dst} AS (SELECT id * 16 + i % 16 AS id, i // 16 AS i, v FROM {src})"


def _attention(x: str, y: str, salt: int) -> list[str]:
    p = f"A{salt}"
    return [
        *_group_norm(f"{p}g", x, 2, 4, salt), _pixels(f"{p}f", f"{p}g"), _linear(f"{p}q", f"{p}f", 4, salt + 2, False), _linear(f"{p}k", f"{p}f", 4, salt + 3, False), _linear(f"{p}v", f"{p}f", 4, salt + 4, False),
        f"{p}s AS (SELECT q.id, k.id AS kid, sum(q.v * k.v) / 2 AS s FROM {p}q q JOIN {p}k k ON q.id // 16 = k.id // 16 AND q.i = k.i GROUP BY ALL)",
        f"{p}p AS (SELECT id, kid, exp(s) / sum(exp(s)) OVER (PARTITION BY id) AS p FROM {p}s)",
        f"{p}a AS (SELECT p.id, w.i, sum(p.p * w.v) AS v FROM {p}p p JOIN {p}v w ON w.id = p.kid GROUP BY ALL)",
        _linear(f"{p}o", f"{p}a", 4, salt + 5, False), f"{p}b AS (SELECT id // 16 AS id, i * 16 + id % 16 AS i, v FROM {p}o)", _both(y, x, f"{p}b", "x.v + y.v"),
    ]


def _attention_weights(name: str, salt: int) -> K.Weights:
    w = {f"{name}.norm.w": 1 + bias(4, salt), f"{name}.norm.b": bias(4, salt + 1)}
    return w | {f"{name}.{p}.w": weight(4, 4, salt=salt + 2 + n) for n, p in enumerate("qkvo")}


@query(_sql(_x("x", 0, 64), *_attention("x", "y", 55), last="y"))
def attention_block(spark, sf):
    w = _attention_weights("a", 55)
    return _rows(latents(spark, sf), _image(lambda x: K.attention_block(x, w, "a", 2)))


_MIDDLE = lambda x, y: [*_resnet(x, f"{y}1", 70), *_attention(f"{y}1", f"{y}2", 80), *_resnet(f"{y}2", y, 90)]
_END = lambda x, y, n: [*_group_norm(f"{y}g", x, 2, 4, 100), _map(f"{y}f", f"{y}g", SILU), _conv(y, f"{y}f", n, 102)]


def _autoencoder_weights(side: str, out: int) -> K.Weights:
    w = {"in.w": weight(4, 4, 3, 3, salt=61), "in.b": bias(4, 61), "out.norm.w": 1 + bias(4, 100), "out.norm.b": bias(4, 101), "out.w": weight(out, 4, 3, 3, salt=102), "out.b": bias(out, 102)}
    return w | _resnet_weights(side, 62) | _resnet_weights("mid1", 70) | _attention_weights("mid.attn", 80) | _resnet_weights("mid2", 90)


@query(_sql(_x("x", 0, 64), _conv("c", "x", 4, 61), *_resnet("c", "d", 62), *_MIDDLE("d", "m"), *_END("m", "y", 4), last="y"))
def vae_encode(spark, sf):
    """Moments of two latent channels: one level, attention in the middle."""
    w = _autoencoder_weights("down0", 4)
    return _rows(latents(spark, sf), _image(lambda x: K.encoder(x, w, 1, 2)))


@query(_sql(_x("x", 0, 64), _conv("c", "x", 4, 61), *_MIDDLE("c", "m"), *_resnet("m", "u", 62), *_END("u", "y", 3), last="y"))
def vae_decode(spark, sf):
    w = _autoencoder_weights("up0", 3)
    return _rows(latents(spark, sf), _image(lambda x: K.decoder(x, w, 1, 2)))


# ---------------------------------------------------------------- images


def _cubic(n: int, new: int, table: str) -> str:
    """(o, i, w): bicubic weights that widen when shrinking; rows add up to 1."""
    scale = max(n / new, 1.0)
    x = f"(abs(i + 0.5 - (o + 0.5) * {n} / {new}.0) / {scale})"
    raw = f"CASE WHEN {x} < 1 THEN 1.5 * power({x}, 3) - 2.5 * power({x}, 2) + 1 WHEN {x} < 2 THEN -0.5 * power({x}, 3) + 2.5 * power({x}, 2) - 4 * {x} + 2 ELSE 0 END"
    return f"{table} AS (SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM (SELECT o, i, {raw} AS w FROM range({new}) a(o), range({n}) b(i)))"


@query(
    f"WITH {CELLS}, {_cubic(8, 5, 'wy')}, {_cubic(8, 12, 'wx')} SELECT vec_id, wy.o * 12 + wx.o AS i, {q6('sum(v * wy.w * wx.w)')} AS y FROM cells JOIN wy ON wy.i = cells.i // 8 JOIN wx ON wx.i = cells.i % 8 GROUP BY vec_id, wy.o, wx.o"
)
def bicubic_resize(spark, sf):
    """8 x 8 to 5 rows (shrinking) and 12 columns (growing)."""
    return _rows(latents(spark, sf), lambda v: np.stack([K.resize_bicubic(x.reshape(8, 8, 1), 5, 12).ravel() for x in v]))


_GRID = """SELECT o, CAST(greatest(0, least(7, b + k)) AS BIGINT) AS i, sum(CASE WHEN x <= 1 THEN 1.25 * x * x * x - 2.25 * x * x + 1 WHEN x < 2 THEN -0.75 * x * x * x + 3.75 * x * x - 6 * x + 3 ELSE 0 END) AS w
FROM (SELECT o, k, floor(s) AS b, abs(s - floor(s) - k) AS x FROM (SELECT o, (o + 0.5) * 8 / 5 - 0.5 AS s FROM range(5) a(o)) p, range(-1, 3) c(k)) GROUP BY ALL"""


@query(f"WITH {CELLS}, g AS ({_GRID}) SELECT vec_id, a.o * 5 + b.o AS i, {q6('sum(v * a.w * b.w)')} AS y FROM cells JOIN g a ON a.i = cells.i // 8 JOIN g b ON b.i = cells.i % 8 GROUP BY vec_id, a.o, b.o")
def position_grid(spark, sf):
    """A table of 8 x 8 positions resampled to 5 x 5."""
    return _rows(latents(spark, sf), lambda v: np.stack([K.bicubic_grid(x[:, None], 5).ravel() for x in v]))


@query(
    f"""WITH c AS (SELECT vec_id, (vec_id * 7 + i * 13) % 256 AS v, i // 24 AS y, i % 24 AS x FROM embeddings, range(528) t(i)),
h AS (SELECT vec_id, y // 2 AS y, x // 2 AS x, CAST(round_even(avg(v), 0) AS DOUBLE) AS v FROM c GROUP BY ALL),
{_cubic(11, 8, 'wy')}, {_cubic(12, 9, 'wx')},
r AS (SELECT vec_id, wy.o AS y, wx.o AS x, greatest(0, least(255, round_even(round(sum(v * wy.w * wx.w), 9), 0))) AS v FROM h JOIN wy ON wy.i = y JOIN wx ON wx.i = x GROUP BY ALL)
SELECT vec_id, y * 8 + x AS i, CAST(v AS DOUBLE) AS y FROM r WHERE x < 8"""
)
def process_images(spark, sf):
    """22 x 24 pixels: halved by boxes, the shorter side scaled to 8, the middle 8 x 8 cut out."""
    pixels = F.transform(F.sequence(F.lit(0), F.lit(527)), lambda i: ((F.col("vec_id") * 7 + i * 13) % 256).cast("int"))
    rows = latents(spark, sf).select(F.col("vec_id").alias("img_id"), F.lit(22).alias("h"), F.lit(24).alias("w"), F.lit(1).alias("ch"), pixels.alias("data"))
    done = K.process_images(rows, "center", 8, down_factor=8)
    return done.select(F.col("img_id").alias("vec_id"), F.posexplode("data").alias("i", "y")).select("vec_id", "i", F.col("y").cast("double").alias("y"))


@query(f"WITH {CELLS} SELECT vec_id, i, {q6('greatest(least(v * 127.5 + 127.5, 255), 0)')} AS y FROM cells")
def normalize_image(spark, sf):
    """Checked images (one channel, h * w values) from [-1, 1] to [0, 255] before rounding."""
    checked = images.assert_image(F.lit(8), F.lit(8), F.lit(1), F.col("v"))
    unit = F.transform(images.convert(checked, F.lit("11"), "01"), lambda x: x * 255.0)
    return latents(spark, sf).select("vec_id", F.posexplode(unit).alias("i", "y")).select("vec_id", "i", r6(F.col("y")).alias("y"))


@query(
    """SELECT name, CAST(n AS BIGINT) AS n, CAST(value AS DOUBLE) AS value FROM (VALUES ('layer.norm.w', 8, 1.0), ('proj.b', 12, 0.0), ('block0.mod.w', 432, 0.0), ('block0.mod.b', 36, 0.0), ('final.out.w', 192, 0.0), ('final.out.b', 16, 0.0), ('proj.w', 192, NULL), ('head.w', 776, NULL)) t(name, n, value)"""
)
def init_weights(spark, sf):
    """Which weights begin as a constant (null: at random)."""
    shapes = {"layer.norm.w": (8,), "proj.b": (12,), "block0.mod.w": (36, 12), "block0.mod.b": (36,), "final.out.w": (16, 12), "final.out.b": (16,), "proj.w": (12, 16), "head.w": (97, 8)}
    rows = [(k, x.size, float(x.flat[0]) if (x == x.flat[0]).all() else None) for k, x in K.init_weights(shapes).items()]
    return spark.createDataFrame(rows, "name string, n long, value double")


@query(f"WITH {CELLS}, p AS (SELECT a.vec_id, a.i, a.v AS mean, b.v AS log_var FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND b.i = a.i + 32 WHERE a.i < 32) SELECT vec_id, i, {q6('mean + exp(0.5 * greatest(-30, least(20, log_var * 50))) * (i % 5 - 2)')} AS y FROM p")
def posterior_sample(spark, sf):
    """Mean and log-variance channels (four each of 2 x 4) with given noise; the log-variance is clipped."""
    noise = (np.arange(32) % 5 - 2.0).reshape(4, 2, 4)

    def one(x: np.ndarray) -> np.ndarray:
        return K.posterior(np.concatenate([x[:32], x[32:] * 50]).reshape(8, 2, 4), noise).ravel()

    return _rows(latents(spark, sf), lambda v: np.stack([one(x) for x in v]))
