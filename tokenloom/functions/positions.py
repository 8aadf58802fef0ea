"""Position and time embeddings as tables (long form: one row per entry)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def timestep_embedding(t: Column, dim: int, max_period: float = 1e4) -> Column:
    """Array: cosines, then sines, of t times the frequencies; a zero at the end if ``dim`` is odd."""
    half = dim // 2
    freqs = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda k: F.exp(-math.log(max_period) * k / half))
    parts = [F.transform(freqs, lambda f: F.cos(t * f)), F.transform(freqs, lambda f: F.sin(t * f))]
    return F.concat(*parts, *([F.array(F.lit(0.0))] if dim % 2 else []))


def sincos_entry(pos: Column, dim: int, k: Column) -> Column:
    """Entry k (0-based) of the 1-d embedding: sines of pos / 10000 ** (k / half), then cosines."""
    if dim % 2:
        raise ValueError("dim must be even")
    half = dim // 2
    angle = pos * F.pow(F.lit(10000.0), -F.pmod(k, F.lit(half)) / float(half))
    return F.when(k < half, F.sin(angle)).otherwise(F.cos(angle))


def sincos_1d(positions: DataFrame, pos: str, dim: int) -> DataFrame:
    """``positions`` with k and value, one row per entry."""
    rows = positions.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))))
    return rows.withColumn("value", sincos_entry(F.col(pos), dim, F.col("k")))


def sincos_2d(spark: SparkSession, dim: int, grid: int, extra_tokens: int = 0, scale: float = 1.0) -> DataFrame:
    """(pos, k, value) of a grid x grid table: the first half encodes x, the second y; ``extra_tokens`` zero rows in front."""
    half = dim // 2
    cells = spark.range(grid * grid).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))))
    x, y = F.pmod("id", F.lit(grid)) / scale, F.floor(F.col("id") / grid) / scale
    value = F.when(F.col("k") < half, sincos_entry(x, half, F.col("k"))).otherwise(sincos_entry(y, half, F.col("k") - half))
    rows = cells.select((F.col("id") + extra_tokens).alias("pos"), "k", value.alias("value"))
    if not extra_tokens:
        return rows
    zeros = spark.range(extra_tokens).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(dim - 1)))).select(F.col("id").alias("pos"), "k", F.lit(0.0).alias("value"))
    return zeros.unionByName(rows)


def rotary_angle(pos: Column, dim: int, k: Column, theta: float = 10000.0) -> Column:
    """Angle of entry k: the same frequency in both halves."""
    return pos * F.pow(F.lit(theta), -2.0 * F.pmod(k, F.lit(dim // 2)) / dim)


def apply_rotary(v: Column, pos: Column, theta: float = 10000.0) -> Column:
    """v * cos + rotate_half(v) * sin; the width is taken from the vector."""
    half = (F.size(v) / 2).cast("int")

    def entry(x: Column, k: Column) -> Column:
        angle = pos * F.pow(F.lit(theta), -2.0 * F.pmod(k, half) / F.size(v))
        other = F.when(k < half, -F.get(v, k + half)).otherwise(F.get(v, k - half))
        return x * F.cos(angle) + other * F.sin(angle)

    return F.transform(v, entry)
