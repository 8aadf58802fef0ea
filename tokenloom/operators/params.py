"""Tables of parameters: params(ord, name, shape, dtype, device, requires_grad, data)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.vectors import all_close, p_norm

# Fixed values of the learning-rate rules and of the model configuration.
VISION_SCALE = 0.1
LAYER_DECAY, LAYERS = 0.931, 32
CONFIG = {
    "latent_size": 32, "patch_size": 2, "latent_channels": 16, "lm_loss_weight": 0.01, "im_loss_weight": 1.0,
    "fm_head_dim": 1536, "fm_head_layers": 12, "fm_head_batch_mul": 4, "use_gen_pos_embed": False,
}


def numel(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("bigint"), lambda n, d: n * d)


def params_info(params: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Trainable elements, in total or by module."""
    return params.where("requires_grad").groupBy(*(by or [])).agg(F.sum(numel(F.col("shape"))).alias("trainable"))


def parameter_names(params: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """Names of parameters that are not directly or deeper under a module of a forbidden type.

    ``params``: name, module_types (types of the modules on the way, outermost first).
    """
    return params.where(~F.arrays_overlap("module_types", F.array(*map(F.lit, forbidden)))).select("name")


def decay_names(params: DataFrame, norm_types: Sequence[str]) -> DataFrame:
    return parameter_names(params, norm_types).where(~F.contains("name", F.lit("bias")))


def vision_scale(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("vision_encoder")), VISION_SCALE).otherwise(1.0)


def layer_scale(name: Column, depth: int = LAYERS, decay: float = LAYER_DECAY) -> Column:
    """decay ** (depth - layer - 1) for names with "model.layers", else 1."""
    layer = F.regexp_extract(name, "layers\\.(\\d+)\\.", 1)
    return F.when(F.contains(name, F.lit("model.layers")) & (layer != ""), F.pow(F.lit(decay), depth - layer.try_cast("int") - 1)).otherwise(1.0)


def grouped(params: DataFrame, lr: float, weight_decay: float, scale: Callable[[Column], Column] | None = None, decayed: Sequence[str] | None = None) -> DataFrame:
    """is_decayed, lr_scale, lr, weight_decay, names (in order), n: groups of trainable parameters."""
    name = F.col("name")
    if decayed is None:
        is_decayed = ~(F.contains(name, F.lit("bias")) | (F.size("shape") == 1))
    else:
        is_decayed = name.isin(list(decayed))
    rows = params.where("requires_grad").select("ord", "name", "shape", is_decayed.alias("is_decayed"), (scale(name) if scale else F.lit(1.0)).alias("lr_scale"))
    groups = rows.groupBy("is_decayed", "lr_scale").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("names"), F.sum(numel(F.col("shape"))).alias("n"))
    return groups.select("is_decayed", "lr_scale", (F.col("lr_scale") * lr).alias("lr"), F.when(F.col("is_decayed"), weight_decay).otherwise(0.0).alias("weight_decay"), "names", "n")


def grouped_numel(groups: DataFrame) -> DataFrame:
    return groups.agg(F.sum("n").alias("n"))


def grad_norm(grads: DataFrame, grad: str, p: float = 2.0, by: list[str] | None = None) -> DataFrame:
    """p-norm of the p-norms; null gradients are left out, none at all is 0."""
    return grads.groupBy(*(by or [])).agg(F.coalesce(F.pow(F.sum(F.pow(p_norm(F.col(grad), p), F.lit(float(p)))), F.lit(1.0 / p)), F.lit(0.0)).alias("norm"))


def state_diff(a: DataFrame, b: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """name, verdict, max_abs, max_rel: a full outer join; verdict is the first test that fails, or "same"."""
    x, y = a.alias("x"), b.alias("y")
    joined = x.join(y, F.col("x.name") == F.col("y.name"), "full")
    p, q = F.col("x.data"), F.col("y.data")
    gap = F.zip_with(p, q, lambda u, v: F.abs(u - v))
    verdict = (
        F.when(F.col("y.name").isNull(), "only_first").when(F.col("x.name").isNull(), "only_second")
        .when(F.col("x.dtype") != F.col("y.dtype"), "type").when(F.col("x.shape") != F.col("y.shape"), "shape")
        .when(F.col("x.device") != F.col("y.device"), "device").when(~all_close(p, q, rtol, atol), "value").otherwise("same")
    )
    comparable = F.coalesce(F.col("x.shape") == F.col("y.shape"), F.lit(False))
    return joined.select(
        F.coalesce("x.name", "y.name").alias("name"),
        verdict.alias("verdict"),
        F.when(comparable, F.array_max(gap)).alias("max_abs"),
        F.when(comparable, F.array_max(F.zip_with(gap, q, lambda g, v: g / (F.abs(v) + 1e-7)))).alias("max_rel"),
    )


def key_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """name, side: names that only one of the two has (two anti joins)."""
    x, y = a.select("name"), b.select("name")
    return x.join(y, "name", "left_anti").withColumn("side", F.lit("first")).unionByName(y.join(x, "name", "left_anti").withColumn("side", F.lit("second")))


def attention_bias(config: DataFrame) -> DataFrame:
    """The output projection's bias flag falls back to the attention's."""
    return config.withColumn("o_attention_bias", F.coalesce("o_attention_bias", "attention_bias"))
