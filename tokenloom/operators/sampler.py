"""Guided sampling: schedules, guidance, and the Euler-Maruyama fold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def timesteps(spark: SparkSession, steps: int, *, shift: float = 1.0, last: float = 0.04) -> DataFrame:
    """i, t, dt: ``steps`` times from 0 to 1 - last, shifted; dt to the next (null at the end)."""
    if steps < 2:
        raise ValueError("at least two steps")
    t = F.col("id") * ((1 - last) / (steps - 1))
    rows = spark.range(steps).select(F.col("id").alias("i"), (t / (shift - (shift - 1) * t)).alias("t"))
    return rows.withColumn("dt", F.lead("t").over(Window.orderBy("i")) - F.col("t"))  # a row a step


def timesteps_to_one(spark: SparkSession, steps: int, *, shift: float = 1.0) -> DataFrame:
    """The variant that ends at 1: ``steps`` shifted times and a last 1."""
    t = F.col("id") / float(steps)
    rows = spark.range(steps + 1).select(F.col("id").alias("i"), F.when(F.col("id") == steps, 1.0).otherwise(t / (shift - (shift - 1) * t)).alias("t"))
    return rows.withColumn("dt", F.lead("t").over(Window.orderBy("i")) - F.col("t"))


def time_of_step(i: Column, steps: int, shift: float, last: float) -> Column:
    t = i * ((1 - last) / (steps - 1))
    return t / (shift - (shift - 1) * t)


def guided(velocities: list[Column], cfg: float, cfg_img: float) -> Column:
    """One, two or three branches: conditional, image-only, unconditional."""
    if len(velocities) == 1:
        return velocities[0]
    if len(velocities) == 2:
        c, u = velocities
        return u + cfg * (c - u)
    c, m, u = velocities
    return u + cfg_img * (m - u) + cfg * (c - m)


def combine_branches(rows: DataFrame, by: list[str], branch: str, value: str, branches: int, cfg: float, cfg_img: float) -> DataFrame:
    """Rows of the branches to one guided value per key (conditional aggregation, no self-join)."""
    parts = [F.max(F.when(F.col(branch) == b, F.col(value))) for b in range(branches)]
    return rows.groupBy(*by).agg(guided(parts, cfg, cfg_img).alias("velocity"))


def score_of(velocity: Column, x: Column, t: Column) -> Column:
    """(t v - x) / (1 - t)."""
    return (t * velocity - x) / (1 - t)


def guidance_scale(step: Column, steps: int, cfg: float, schedule: str) -> Column:
    """Guidance at a step: constant, or linear from cfg towards 1."""
    if schedule == "constant":
        return F.lit(float(cfg))
    if schedule == "linear":
        return 1 + (cfg - 1) * (steps - step) / steps
    raise NotImplementedError(schedule)


def euler(x0: Column, velocity: Callable[[Column, Column], Column], noise: Callable[[Column], Column], *, steps: int = 20, shift: float = 1.0, last: float = 0.04) -> Column:
    """Steps - 1 stochastic steps folded over the step index, then one of length ``last`` without noise."""
    if steps < 2:
        raise ValueError("at least two steps")

    def step(x: Column, i: Column) -> Column:
        t, after = time_of_step(i, steps, shift, last), time_of_step(i + 1, steps, shift, last)
        v = velocity(x, t)
        drift = v + (1 - t) * score_of(v, x, t)
        return x + drift * (after - t) + F.sqrt(2 * (1 - t)) * noise(i) * F.sqrt(after - t)

    end = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 2)), x0, step)
    return F.aggregate(F.array(end), F.lit(0.0), lambda _, x: x + velocity(x, time_of_step(F.lit(steps - 1), steps, shift, last)) * last)
