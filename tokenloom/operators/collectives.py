"""Collectives over a table of per-rank values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_reduce_sum(df: DataFrame, value: Column, by: list[str], out: str = "total") -> DataFrame:
    return df.groupBy(*by).agg(F.sum(value).alias(out))


def all_reduce_mean(df: DataFrame, value: Column, world_size: int, by: list[str], out: str = "mean") -> DataFrame:
    """Sum over ranks divided by the number of ranks (not of rows)."""
    return df.groupBy(*by).agg((F.sum(value) / world_size).alias(out))


def all_reduce_both(df: DataFrame, value: Column, world_size: int, by: list[str]) -> DataFrame:
    """total and mean in one pass."""
    return all_reduce_sum(df, value, by).withColumn("mean", F.col("total") / world_size)


def all_gather(df: DataFrame, rank: str, value: str, by: list[str]) -> DataFrame:
    """by, values: one value per rank, in order of rank; ``df`` has one row per rank and group, so a list is as long as the world is large."""
    return df.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(rank, value))), lambda x: x[value]).alias("values"))


def mean_dict(df: DataFrame, metrics: str, world_size: int) -> DataFrame:
    """key, mean: union of keys; a key that a rank lacks counts as 0 there."""
    return df.select(F.explode(metrics).alias("key", "value")).groupBy("key").agg((F.sum("value") / world_size).alias("mean"))


def broadcast_object(df: DataFrame, rank: str, value: str, src: int = 0) -> DataFrame:
    """``df`` with the value of rank ``src`` on every row (a single value, so it is broadcast)."""
    one = df.where(F.col(rank) == src).agg(F.first(value).alias("received"))
    return df.crossJoin(F.broadcast(one))
