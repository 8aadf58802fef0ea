"""The training loss of a mixed sequence: each position's hidden state goes to the head that its next token asks for.

``positions``: sample_id, pos, token_id, label, hidden (array); ``patches``: sample_id, place, target (array: the flattened patch)
in the order of the sample's placeholders; ``masks``: sample_id, mask (0 or 1 for the image of the sample).

A position whose next token is the image placeholder belongs to the image head, any other to the language head; a
sample's last position belongs to neither.  Language positions give cross entropy, image positions the masked flow
loss over ``batch_mul`` draws of noise and time each.  Both sums are taken in one aggregation, so the batch is read
once, and one row comes back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.vectors import log_sum_exp
from tokenloom.operators.layout import hash_normal, hash_uniform
from tokenloom.operators.losses import BATCH_MUL, IMAGE_WEIGHT, LM_WEIGHT, flow_target, row_mse, total_loss
from tokenloom.operators.prompts import IGNORE_INDEX


def routed(positions: DataFrame, placeholder: int) -> DataFrame:
    """sample_id, pos, hidden, target, is_image, place: positions with a successor; place: number of the placeholder that follows, in its sample."""
    w = Window.partitionBy("sample_id").orderBy("pos")
    rows = positions.withColumn("next", F.lead("token_id").over(w)).withColumn("target", F.lead("label").over(w)).withColumn("later", F.lead("pos").over(w))
    image = F.coalesce(F.col("next") == placeholder, F.lit(False))
    before = Window.partitionBy("sample_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("is_image", image & F.col("later").isNotNull())
    rows = rows.withColumn("place", F.coalesce(F.sum(F.col("is_image").cast("long")).over(before), F.lit(0)))
    return rows.where("later is not null").select("sample_id", "pos", "hidden", "target", "is_image", "place")


def training_loss(
    positions: DataFrame,
    patches: DataFrame,
    masks: DataFrame,
    *,
    placeholder: int,
    logits: Callable[[Column], Column],
    velocity: Callable[[Column, Column, Column], Column],
    seed: int = 0,
    batch_mul: int = BATCH_MUL,
    lm_weight: float = LM_WEIGHT,
    image_weight: float = IMAGE_WEIGHT,
) -> DataFrame:
    """One row: lm_loss, im_loss, loss, n_tokens, n_patches.

    ``logits``: hidden to the vocabulary's logits; ``velocity``: (noisy patch, time, hidden) to a patch.  Labels that are null or
    ignored do not count; without any the language loss is not a number, which is an error, as is any loss that is not finite.
    Without patches (or with a weight of 0) the image loss is 0.  Numbers of placeholders and patches must agree in each sample.
    """
    rows = routed(positions, placeholder)
    image_on = image_weight > 0
    patched = patches.select("sample_id", "place", F.col("target").alias("patch")).join(masks.select("sample_id", "mask"), "sample_id", "left")
    joined = rows.where("is_image").join(patched, ["sample_id", "place"], "full")
    wrong = F.col("patch").isNull() | F.col("hidden").isNull()
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("placeholders and patches of sample "), F.col("sample_id").cast("string"), F.lit(" differ in number"))).cast("double"))

    drawn = joined.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(batch_mul - 1))))
    key = [F.col("sample_id"), F.col("place"), F.col("rep")]
    noise = F.transform("patch", lambda _, i: hash_normal(seed, *key, i))
    drawn = drawn.withColumn("noise", noise).withColumn("t", hash_uniform(seed, F.lit("t"), *key))
    x, u = flow_target(F.col("patch"), F.col("noise"), F.col("t"))
    drawn = drawn.withColumn("x", x).withColumn("u", u)
    image = drawn.select(F.lit(None).cast("double").alias("lm"), F.coalesce(checked, row_mse(velocity(F.col("x"), F.col("t"), F.col("hidden")), F.col("u"))).alias("im"), F.coalesce(F.col("mask"), F.lit(0)).cast("double").alias("m"), F.col("rep"))

    used = rows.where(~F.col("is_image") & F.col("target").isNotNull() & (F.col("target") != IGNORE_INDEX)).withColumn("z", logits(F.col("hidden")))
    language = used.select((log_sum_exp(F.col("z")) - F.get("z", F.col("target").cast("int"))).alias("lm"), F.lit(None).cast("double").alias("im"), F.lit(0.0).alias("m"), F.lit(-1).alias("rep"))
    both = language.unionByName(image) if image_on else language
    sums = both.agg(
        F.coalesce(F.avg("lm"), F.lit(float("nan"))).alias("lm_loss"),
        F.coalesce(F.sum(F.col("im") * F.col("m")) / (F.sum(F.when(F.col("im").isNotNull(), F.col("m"))) + 1e-8), F.lit(0.0)).alias("im_loss"),
        F.count("lm").alias("n_tokens"),
        F.count(F.when(F.col("rep") == 0, 1)).alias("n_patches"),
    )
    return sums.select("lm_loss", "im_loss", total_loss(F.col("lm_loss"), F.col("im_loss"), lm_weight, image_weight).alias("loss"), "n_tokens", "n_patches")
