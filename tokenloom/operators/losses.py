"""Training losses from given hidden states, logits and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.vectors import log_sum_exp, total
from tokenloom.operators.prompts import IGNORE_INDEX

LM_WEIGHT, IMAGE_WEIGHT = 0.01, 1.0  # fixed values
BATCH_MUL = 4  # fixed value: how often the image batch is repeated


def shift_targets(tokens: DataFrame, sample: str, pos: str, label: str) -> DataFrame:
    """Each position with the label of the next one; the last position of a sample has none and goes."""
    w = Window.partitionBy(sample).orderBy(pos)
    shifted = tokens.withColumn("target", F.lead(label).over(w)).withColumn("_next", F.lead(pos).over(w))
    return shifted.where(F.col("_next").isNotNull()).drop("_next")


def cross_entropy(rows: DataFrame, logits: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Mean of log-sum-exp less the label's logit; ignored labels do not count."""
    used = rows.where((F.col(label) != IGNORE_INDEX) & F.col(label).isNotNull())
    loss = log_sum_exp(F.col(logits)) - F.get(logits, F.col(label))
    return used.groupBy(*(by or [])).agg(F.avg(loss).alias("loss"), F.count("*").alias("n"))


def row_mse(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / F.size(a)


def flow_target(x: Column, noise: Column, t: Column) -> tuple[Column, Column]:
    """Interpolated input t x + (1 - t) n and velocity x - n."""
    return F.zip_with(x, noise, lambda a, n: t * a + (1 - t) * n), F.zip_with(x, noise, lambda a, n: a - n)


def masked_mean(rows: DataFrame, loss: Column, mask: Column | None, by: list[str] | None = None) -> DataFrame:
    """Sum of loss * mask over (sum of mask + 1e-8); without a mask the mean."""
    out = F.avg(loss) if mask is None else F.sum(loss * mask) / (F.sum(mask) + 1e-8)
    return rows.groupBy(*(by or [])).agg(out.alias("loss"))


def repeat_batch(rows: DataFrame, times: int = BATCH_MUL) -> DataFrame:
    return rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def total_loss(lm: Column, image: Column, lm_weight: float = LM_WEIGHT, image_weight: float = IMAGE_WEIGHT) -> Column:
    """Weighted sum; a loss that is not finite is an error."""

    def sound(x: Column, name: str) -> Column:
        bad = F.isnan(x) | (F.abs(x) == float("inf"))
        return F.when(bad, F.raise_error(F.concat(F.lit(f"{name} loss is "), x.cast("string"))).cast("double")).otherwise(x)

    return sound(lm, "LM") * lm_weight + sound(image, "image") * image_weight
