"""The tiny end-to-end model: captions to latent images, and the training loss, with fixed small weights.

Weights of real size are not available here; the model shows the composition (branches, prefill with
a cache, a guided flow sampler per token, unpatchify) at a width that tests can follow.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.operators import kernels as K
from tokenloom.operators.prompts import guidance_branches, guidance_captions, repeat_captions, with_positive, word_id, words


@dataclass(frozen=True)
class TinyModel:
    hidden: int = 8
    layers: int = 2
    heads: int = 2
    kv_heads: int = 1
    mlp: int = 16
    token: int = 16  # 4 channels x 2 x 2
    vocabulary: int = 97
    width: int = 12
    blocks: int = 2
    freq_dim: int = 6
    seed: int = 0

    def weights(self) -> K.Weights:
        shapes = K.backbone_shapes(self.hidden, self.layers, self.heads, self.kv_heads, self.mlp) | K.velocity_shapes(self.token, self.hidden, self.width, self.blocks, self.freq_dim)
        shapes |= {"embed": (self.vocabulary, self.hidden), "image.in.w": (self.hidden, self.token), "head.w": (self.vocabulary, self.hidden)}
        w = K.init_weights(shapes, self.seed, 0.3)
        rng = np.random.default_rng(self.seed + 1)  # a trained final layer is not zero
        w["final.out.w"] = rng.normal(0, 0.3, w["final.out.w"].shape)
        return K.check_size(w)


def noise(seed: int, sample: int, step: int, n: int) -> np.ndarray:
    return np.random.default_rng([seed, sample, step]).normal(size=n)


def sample_token(model: TinyModel, w: K.Weights, c: np.ndarray, cfg: float, cfg_img: float, seed: int, sample: int, at: int, steps: int, shift: float = 1.0, last: float = 0.04) -> np.ndarray:
    """One image token from the conditions of its branches (rows of ``c``)."""
    from_seed = lambda k: noise(seed, sample, at * (steps + 1) + k, model.token)
    t = np.linspace(0, 1 - last, steps)
    t = t / (shift - (shift - 1) * t)
    x = from_seed(steps)

    def velocity(x: np.ndarray, t: float) -> np.ndarray:
        v = K.velocity_net(np.tile(x, (len(c), 1)), np.full(len(c), t), c, w, model.blocks, model.freq_dim)
        if len(v) == 1:
            return v[0]
        if len(v) == 2:
            return v[1] + cfg * (v[0] - v[1])
        return v[2] + cfg_img * (v[1] - v[2]) + cfg * (v[0] - v[1])

    for k in range(steps - 1):
        v, dt = velocity(x, t[k]), t[k + 1] - t[k]
        score = (t[k] * v - x) / (1 - t[k])
        x = x + (v + (1 - t[k]) * score) * dt + np.sqrt(2 * (1 - t[k])) * from_seed(k) * np.sqrt(dt)
    return x + velocity(x, t[-1]) * last


def generate(captions: DataFrame, model: TinyModel, *, hw: tuple[int, int] = (4, 4), repeats: int = 1, positive: str | None = None, negative: str | None = None, cfg: float = 1.0, cfg_img: float = 1.0, schedule: str = "constant", steps: int = 4, shift: float = 1.0, use_norm: bool = False, seed: int = 42) -> DataFrame:
    """sample_id, rep, latent (4, h, w as an array): all branches of a sample are decoded together, one group a sample."""
    w, (h, wd) = model.weights(), hw
    n_tokens, branches = (h // 2) * (wd // 2), guidance_branches(cfg, cfg_img)
    rows = repeat_captions(captions.select("sample_id", "caption"), repeats).withColumn("caption", with_positive(F.col("caption"), positive))
    if branches == 3:
        rows = rows.withColumn("h", F.lit(h * 16)).withColumn("w", F.lit(wd * 16))
    rows = guidance_captions(rows, cfg=cfg, cfg_img=cfg_img, negative=negative)
    tokens = F.transform(words(F.col("caption")), lambda x: F.pmod(word_id(x), F.lit(model.vocabulary)).cast("int"))
    rows = rows.select("sample_id", "rep", "branch", F.concat(F.array(F.lit(0)), tokens).alias("ids"))

    def decode(table: pa.Table) -> pa.Table:
        ids = [x for _, x in sorted(zip(table.column("branch").to_pylist(), table.column("ids").to_pylist(), strict=True))]
        sample, rep = table.column("sample_id")[0].as_py(), table.column("rep")[0].as_py()
        caches: list[dict] = [{} for _ in ids]
        last = np.stack([K.backbone(w["embed"][np.array(x)], w, model.layers, model.heads, model.kv_heads, c)[-1] for x, c in zip(ids, caches, strict=True)])
        made = []
        for at in range(n_tokens):
            scale = cfg if schedule == "constant" else 1 + (cfg - 1) * (n_tokens - at) / n_tokens
            x = sample_token(model, w, last, scale, cfg_img, seed, sample * 1000 + rep, at, steps, shift)
            made.append(K.layer_norm(x) if use_norm else x)
            e = K.linear(made[-1][None], w, "image.in")
            last = np.stack([K.backbone(e, w, model.layers, model.heads, model.kv_heads, c)[-1] for c in caches])
        lat = np.stack(made).reshape(h // 2, wd // 2, 4, 2, 2).transpose(2, 0, 3, 1, 4).ravel()
        return pa.table({"sample_id": [sample], "rep": [rep], "latent": pa.array([lat], pa.list_(pa.float64()))}, schema=pa.schema([("sample_id", pa.int64()), ("rep", pa.int64()), ("latent", pa.list_(pa.float64()))]))

    return rows.groupBy("sample_id", "rep").applyInArrow(decode, "sample_id bigint, rep bigint, latent array<double>")


def last_logits(tokens: DataFrame, model: TinyModel) -> DataFrame:
    """sample_id, n, logits of the last position; ``tokens``: sample_id, ids (array)."""
    w = model.weights()

    def run(batches):
        for batch in batches:
            out = [K.linear(K.backbone(w["embed"][np.array(x) % model.vocabulary], w, model.layers, model.heads, model.kv_heads)[-1:], w, "head")[0] if x else None for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sample_id"), pa.array([len(x or []) for x in batch.column("ids").to_pylist()], pa.int64()), pa.array(out, pa.list_(pa.float64()))], names=["sample_id", "n", "logits"])

    return tokens.select("sample_id", "ids").mapInArrow(run, "sample_id bigint, n bigint, logits array<double>")
