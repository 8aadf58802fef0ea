"""Numeric kernels at real width: numpy on Arrow batches, weights sent with the function.

Weights are a dictionary of arrays of a model of fixed size; ``check_size`` refuses to send more
than ``MOST_BYTES`` of them with a task.  Beyond that they belong in files that each worker opens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tokenloom.operators.attention import attend

MOST_BYTES = 256_000_000
Weights = dict[str, np.ndarray]


def check_size(weights: Weights) -> Weights:
    size = sum(w.nbytes for w in weights.values())
    if size > MOST_BYTES:
        raise ValueError(f"weights of {size} bytes are not sent with tasks")
    return weights


def init_weights(shapes: dict[str, tuple[int, ...]], seed: int = 0, std: float = 0.02) -> Weights:
    """Normal weights; biases zero, norms one, modulation and final layers zero."""
    rng = np.random.default_rng(seed)
    out: Weights = {}
    for name, shape in shapes.items():
        if "norm" in name and name.endswith("w"):
            out[name] = np.ones(shape)
        elif name.endswith(".b") or name.startswith("final.") or ".mod." in name:
            out[name] = np.zeros(shape)
        else:
            out[name] = rng.normal(0, std, shape)
    return out


def silu(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.exp(-x))


def linear(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    y = x @ w[f"{name}.w"].T
    return y + w[f"{name}.b"] if f"{name}.b" in w else y


def layer_norm(x: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    c = x - x.mean(axis=-1, keepdims=True)
    return c / np.sqrt((c * c).mean(axis=-1, keepdims=True) + eps)


def rms_norm(x: np.ndarray, weight: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    return x / np.sqrt((x * x).mean(axis=-1, keepdims=True) + eps) * weight


def modulate(x: np.ndarray, shift: np.ndarray | None, scale: np.ndarray) -> np.ndarray:
    y = x * (1 + scale)
    return y if shift is None else y + shift


def timestep_embedding(t: np.ndarray, dim: int, max_period: float = 1e4) -> np.ndarray:
    half = dim // 2
    angle = t[:, None] * np.exp(-np.log(max_period) * np.arange(half) / half)
    return np.concatenate([np.cos(angle), np.sin(angle), np.zeros((len(t), dim % 2))], axis=1)


def time_embed(t: np.ndarray, w: Weights, dim: int) -> np.ndarray:
    return linear(silu(linear(timestep_embedding(t, dim), w, "time.in")), w, "time.out")


def gated_mlp(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    return linear(silu(linear(x, w, f"{name}.gate")) * linear(x, w, f"{name}.up"), w, f"{name}.down")


def residual_block(x: np.ndarray, y: np.ndarray, w: Weights, name: str) -> np.ndarray:
    shift, scale, gate = np.split(linear(silu(y), w, f"{name}.mod"), 3, axis=-1)
    h = modulate(layer_norm(x) * w[f"{name}.norm.w"] + w[f"{name}.norm.b"], shift, scale)
    return x + gate * linear(silu(linear(h, w, f"{name}.in")), w, f"{name}.out")


def final_layer(x: np.ndarray, c: np.ndarray, w: Weights) -> np.ndarray:
    shift, scale = np.split(linear(silu(c), w, "final.mod"), 2, axis=-1)
    return linear(modulate(layer_norm(x), shift, scale), w, "final.out")


def velocity_net(x: np.ndarray, t: np.ndarray, c: np.ndarray, w: Weights, blocks: int, freq_dim: int) -> np.ndarray:
    """Velocity of noisy tokens x at times t under conditions c."""
    h, y = linear(x, w, "proj"), time_embed(t, w, freq_dim) + linear(c, w, "cond")
    for k in range(blocks):
        h = residual_block(h, y, w, f"block{k}")
    return final_layer(h, y, w)


def velocity_shapes(token: int, cond: int, width: int, blocks: int, freq_dim: int) -> dict[str, tuple[int, ...]]:
    out: dict[str, tuple[int, ...]] = {"proj.w": (width, token), "proj.b": (width,), "cond.w": (width, cond), "cond.b": (width,), "time.in.w": (width, freq_dim), "time.in.b": (width,), "time.out.w": (width, width), "time.out.b": (width,)}
    for k in range(blocks):
        n = f"block{k}"
        out |= {f"{n}.norm.w": (width,), f"{n}.norm.b": (width,), f"{n}.in.w": (width, width), f"{n}.in.b": (width,), f"{n}.out.w": (width, width), f"{n}.out.b": (width,), f"{n}.mod.w": (3 * width, width), f"{n}.mod.b": (3 * width,)}
    return out | {"final.mod.w": (2 * width, width), "final.mod.b": (2 * width,), "final.out.w": (token, width), "final.out.b": (token,)}


def rotate(x: np.ndarray, pos: np.ndarray, theta: float = 10000.0) -> np.ndarray:
    """Rotary position of rows x (..., positions, width)."""
    half = x.shape[-1] // 2
    angle = pos[:, None] * theta ** (-np.arange(half) / half)
    cos, sin = np.tile(np.cos(angle), 2), np.tile(np.sin(angle), 2)
    return x * cos + np.concatenate([-x[..., half:], x[..., :half]], axis=-1) * sin


def decoder_layer(x: np.ndarray, w: Weights, name: str, heads: int, kv_heads: int, cache: dict[str, list[np.ndarray]] | None = None) -> np.ndarray:
    """x + attention(norm x), then + mlp(norm x).  With a cache, rows x follow those seen before."""
    n = len(cache[name][0]) if cache and name in cache else 0
    h = rms_norm(x, w[f"{name}.norm1.w"])
    q, k, v = (linear(h, w, f"{name}.{p}") for p in "qkv")
    d = q.shape[1] // heads
    pos = n + np.arange(len(x))
    q = np.concatenate([rotate(q[:, a * d : (a + 1) * d], pos) for a in range(heads)], axis=1)
    k = np.concatenate([rotate(k[:, a * d : (a + 1) * d], pos) for a in range(kv_heads)], axis=1)
    if cache is not None:
        old = cache.get(name)
        k, v = (np.concatenate([o, new]) for o, new in zip(old, (k, v), strict=True)) if old else (k, v)
        cache[name] = [k, v]
    out = []
    for a in range(heads):
        b = a * kv_heads // heads
        out.append(attend(q[:, a * d : (a + 1) * d], k[:, b * d : (b + 1) * d], v[:, b * d : (b + 1) * d], True, n))
    x = x + linear(np.concatenate(out, axis=1), w, f"{name}.o")
    return x + gated_mlp(rms_norm(x, w[f"{name}.norm2.w"]), w, f"{name}.mlp")


def backbone(x: np.ndarray, w: Weights, layers: int, heads: int, kv_heads: int, cache: dict | None = None) -> np.ndarray:
    for k in range(layers):
        x = decoder_layer(x, w, f"layer{k}", heads, kv_heads, cache)
    return rms_norm(x, w["norm.w"])


def backbone_shapes(hidden: int, layers: int, heads: int, kv_heads: int, mlp: int) -> dict[str, tuple[int, ...]]:
    d = hidden // heads
    out: dict[str, tuple[int, ...]] = {"norm.w": (hidden,)}
    for k in range(layers):
        n = f"layer{k}"
        out |= {f"{n}.norm1.w": (hidden,), f"{n}.norm2.w": (hidden,), f"{n}.q.w": (hidden, hidden), f"{n}.k.w": (kv_heads * d, hidden), f"{n}.v.w": (kv_heads * d, hidden), f"{n}.o.w": (hidden, hidden)}
        out |= {f"{n}.mlp.gate.w": (mlp, hidden), f"{n}.mlp.up.w": (mlp, hidden), f"{n}.mlp.down.w": (hidden, mlp)}
    return out


def conv2d(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray | None = None, stride: int = 1, pad: tuple[int, int, int, int] = (1, 1, 1, 1)) -> np.ndarray:
    """x (channels, h, w), kernel (out, channels, kh, kw); pad: top, bottom, left, right."""
    top, bottom, left, right = pad
    x = np.pad(x, ((0, 0), (top, bottom), (left, right)))
    views = np.lib.stride_tricks.sliding_window_view(x, kernel.shape[2:], axis=(1, 2))[:, ::stride, ::stride]
    out = np.einsum("chwij,ocij->ohw", views, kernel)
    return out if bias is None else out + bias[:, None, None]


def group_norm(x: np.ndarray, groups: int, weight: np.ndarray, bias: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    y = layer_norm(x.reshape(groups, -1), eps).reshape(x.shape)
    return y * weight[:, None, None] + bias[:, None, None]


def resnet_block(x: np.ndarray, w: Weights, name: str, groups: int) -> np.ndarray:
    h = conv2d(silu(group_norm(x, groups, w[f"{name}.norm1.w"], w[f"{name}.norm1.b"])), w[f"{name}.conv1.w"], w[f"{name}.conv1.b"])
    h = conv2d(silu(group_norm(h, groups, w[f"{name}.norm2.w"], w[f"{name}.norm2.b"])), w[f"{name}.conv2.w"], w[f"{name}.conv2.b"])
    if f"{name}.skip.w" in w:
        x = conv2d(x, w[f"{name}.skip.w"], w[f"{name}.skip.b"], pad=(0, 0, 0, 0))
    return x + h


def attention_block(x: np.ndarray, w: Weights, name: str, groups: int) -> np.ndarray:
    """Full single-head attention over the pixels."""
    flat = group_norm(x, groups, w[f"{name}.norm.w"], w[f"{name}.norm.b"]).reshape(len(x), -1).T
    q, k, v = (linear(flat, w, f"{name}.{p}") for p in "qkv")
    return x + linear(attend(q, k, v, False), w, f"{name}.o").T.reshape(x.shape)


def downsample(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    return conv2d(x, w[f"{name}.w"], w[f"{name}.b"], stride=2, pad=(0, 1, 0, 1))


def upsample(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    return conv2d(x.repeat(2, axis=1).repeat(2, axis=2), w[f"{name}.w"], w[f"{name}.b"])


def encoder(x: np.ndarray, w: Weights, levels: int, groups: int) -> np.ndarray:
    """Down the levels, a middle with attention, then moments (mean and log-variance channels)."""
    h = conv2d(x, w["in.w"], w["in.b"])
    for k in range(levels):
        h = resnet_block(h, w, f"down{k}", groups)
        if k + 1 < levels:
            h = downsample(h, w, f"down{k}.sample")
    h = resnet_block(attention_block(resnet_block(h, w, "mid1", groups), w, "mid.attn", groups), w, "mid2", groups)
    return conv2d(silu(group_norm(h, groups, w["out.norm.w"], w["out.norm.b"])), w["out.w"], w["out.b"])


def decoder(z: np.ndarray, w: Weights, levels: int, groups: int) -> np.ndarray:
    h = conv2d(z, w["in.w"], w["in.b"])
    h = resnet_block(attention_block(resnet_block(h, w, "mid1", groups), w, "mid.attn", groups), w, "mid2", groups)
    for k in reversed(range(levels)):
        h = resnet_block(h, w, f"up{k}", groups)
        if k:
            h = upsample(h, w, f"up{k}.sample")
    return conv2d(silu(group_norm(h, groups, w["out.norm.w"], w["out.norm.b"])), w["out.w"], w["out.b"])


def autoencoder_shapes(image: int, latent: int, widths: list[int], decode: bool) -> dict[str, tuple[int, ...]]:
    """Weights of ``encoder`` (image to 2 * latent moments) or ``decoder``; one width per level."""
    conv = lambda n, o, i, k=3: {f"{n}.w": (o, i, k, k), f"{n}.b": (o,)}
    norm = lambda n, c: {f"{n}.w": (c,), f"{n}.b": (c,)}

    def block(n: str, i: int, o: int) -> dict[str, tuple[int, ...]]:
        return norm(f"{n}.norm1", i) | conv(f"{n}.conv1", o, i) | norm(f"{n}.norm2", o) | conv(f"{n}.conv2", o, o) | (conv(f"{n}.skip", o, i, 1) if i != o else {})

    deep, out = widths[-1], {}
    steps = list(enumerate(widths))
    if decode:
        out, c = conv("in", deep, latent), deep
        for k, o in reversed(steps):
            out |= block(f"up{k}", c, o) | (conv(f"up{k}.sample", o, o) if k else {})
            c = o
        out |= norm("out.norm", c) | conv("out", image, c)
    else:
        out, c = conv("in", widths[0], image), widths[0]
        for k, o in steps:
            out |= block(f"down{k}", c, o) | (conv(f"down{k}.sample", o, o) if k + 1 < len(widths) else {})
            c = o
        out |= norm("out.norm", c) | conv("out", 2 * latent, c)
    out |= block("mid1", deep, deep) | block("mid2", deep, deep) | norm("mid.attn.norm", deep)
    return out | {f"mid.attn.{p}.w": (deep, deep) for p in "qkvo"}


def posterior(moments: np.ndarray, noise: np.ndarray | None = None) -> np.ndarray:
    """Mean (no noise) or a sample of the Gaussian given by mean and log-variance channels."""
    mean, log_var = np.split(moments, 2, axis=0)
    return mean if noise is None else mean + np.exp(0.5 * np.clip(log_var, -30, 20)) * noise


def autoencode(x: np.ndarray, encode: Weights, decode: Weights, levels: int, groups: int, noise: np.ndarray | None = None, shift: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The decoded image and the moments.

    The latent is the posterior's mean, or a sample if ``noise`` is given; ``shift`` is added to it (for a latent disturbed with
    strength s: normal numbers times one uniform number below s for the image).
    """
    moments = encoder(x, encode, levels, groups)
    z = posterior(moments, noise)
    return decoder(z if shift is None else z + shift, decode, levels, groups), moments


def bicubic_grid(table: np.ndarray, new: int, a: float = -0.75) -> np.ndarray:
    """A square grid of vectors (side * side, width) resampled to new * new by bicubic interpolation (no corner alignment)."""
    side = int(round(np.sqrt(len(table))))
    if side * side != len(table):
        raise ValueError("not a square grid")
    src = (np.arange(new) + 0.5) * side / new - 0.5
    base = np.floor(src).astype(int)
    weights = np.zeros((new, side))
    for k in range(-1, 3):
        x = np.abs(src - (base + k))
        w = np.where(x <= 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, ((a * x - 5 * a) * x + 8 * a) * x - 4 * a, 0.0))
        np.add.at(weights, (np.arange(new), np.clip(base + k, 0, side - 1)), w)
    g = table.reshape(side, side, -1)
    return np.einsum("ai,bj,ijc->abc", weights, weights, g).reshape(new * new, -1)


def resample_weights(n: int, new: int, a: float = -0.5) -> np.ndarray:
    """(new, n) weights of bicubic resampling; the kernel widens when shrinking, and rows add up to 1."""
    scale = max(n / new, 1.0)
    centre = (np.arange(new) + 0.5) * n / new
    x = np.abs(np.arange(n) + 0.5 - centre[:, None]) / scale
    w = np.where(x < 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, ((x - 5) * x + 8) * x * a - 4 * a, 0.0))
    return w / w.sum(axis=1, keepdims=True)


def resize_bicubic(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """image (height, width, channels) of bytes or floats to (h, w), bytes rounded and clipped."""
    out = np.einsum("ai,bj,ijc->abc", resample_weights(image.shape[0], h), resample_weights(image.shape[1], w), image.astype(float))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8) if image.dtype == np.uint8 else out


def box_halvings(image: np.ndarray, size: int) -> np.ndarray:
    """Halve both sides by means of boxes while the shorter is at least twice ``size``; boxes of odd sides take two or three pixels."""

    def first(n: int) -> np.ndarray:
        """First pixel of each box: the one after the last whose middle is inside the box before."""
        box = -(-(2 * np.arange(n) + 1) * (n // 2) // (2 * n)) - 1
        return np.searchsorted(box, np.arange(n // 2))

    while min(image.shape[:2]) >= 2 * size:
        y, x = first(image.shape[0]), first(image.shape[1])
        sums = np.add.reduceat(np.add.reduceat(image.astype(float), y, axis=0), x, axis=1)
        image = sums / np.outer(np.diff([*y, image.shape[0]]), np.diff([*x, image.shape[1]]))[:, :, None]
    return image


def crop_images(rows: DataFrame, size: int, crop: bool = True) -> DataFrame:
    """img_id, h, w, ch, data (bytes as integers) to size x size: resized and cut in the middle, or padded with black and resized."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, w, ch, data in zip(*[batch.column(c).to_pylist() for c in ("h", "w", "ch", "data")], strict=True):
                x = np.array(data, float).reshape(h, w, ch)
                if not crop:
                    side = max(h, w)
                    square = np.zeros((side, side, ch))
                    square[(side - h) // 2 : (side - h) // 2 + h, (side - w) // 2 : (side - w) // 2 + w] = x
                    x = square
                x = box_halvings(x, size)
                scale = size / min(x.shape[:2])
                x = resize_bicubic(np.clip(np.rint(x), 0, 255).astype(np.uint8), round(x.shape[0] * scale), round(x.shape[1] * scale))
                y0, x0 = (x.shape[0] - size) // 2, (x.shape[1] - size) // 2
                out.append(x[y0 : y0 + size, x0 : x0 + size].ravel().tolist())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("img_id"), pa.array([size] * n, pa.int32()), pa.array([size] * n, pa.int32()), batch.column("ch"), pa.array(out, pa.list_(pa.int32()))], names=["img_id", "h", "w", "ch", "data"])

    key, ch = rows.schema["img_id"].dataType.simpleString(), rows.schema["ch"].dataType.simpleString()
    return rows.select("img_id", "h", "w", "ch", "data").mapInArrow(run, f"img_id {key}, h int, w int, ch {ch}, data array<int>")


def process_images(rows: DataFrame, crop_mode: str, size: int | None = None, down_factor: int = 16) -> DataFrame:
    if crop_mode == "original":
        raise NotImplementedError(crop_mode)
    if crop_mode != "center":
        raise ValueError(crop_mode)
    if not size or size % down_factor:
        raise ValueError(f"a size divisible by {down_factor} is needed")
    return crop_images(rows, size)


def map_vectors(rows: DataFrame, column: str, out: str, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply ``fn`` (rows x width -> rows x width') to an array column, batch by batch."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = fn(np.array(batch.column(column).to_pylist(), float))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(y), pa.list_(pa.float64()))], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, schema)
