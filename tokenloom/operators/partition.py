"""Dataset partitioners: all ranks' indices in one DataFrame of (id, rank, slot)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.ordering import global_index


def contiguous_rank(i: Column, n: int, ranks: int) -> Column:
    """Rank of row i: the first n % ranks ranks have one row more, nothing is padded."""
    size, more = n // ranks, n % ranks
    head = more * (size + 1)
    return F.when(i < head, F.floor(i / (size + 1))).otherwise(more + F.floor((i - head) / max(size, 1))).cast("long")


def contiguous_start(rank: Column, n: int, ranks: int) -> Column:
    return rank * (n // ranks) + F.least(rank, F.lit(n % ranks))


def no_pad(df: DataFrame, id_col: str, ranks: int) -> DataFrame:
    """id, rank, slot: contiguous, disjoint, complete shards in order of id."""
    rows = df.select(id_col)
    n = rows.count()
    rows = global_index(rows, [id_col])
    rank = contiguous_rank(F.col("idx"), n, ranks)
    return rows.select(F.col(id_col).alias("id"), rank.alias("rank"), (F.col("idx") - contiguous_start(rank, n, ranks)).alias("slot"))


def repeat_no_pad(df: DataFrame, id_col: str, ranks: int, repeat: int = 1) -> DataFrame:
    """id, rank, turn, slot: rank r gets the shards r, r + 1, ..., r + repeat - 1 (mod ranks), in that order."""
    shards = no_pad(df, id_col, ranks)
    turns = shards.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repeat - 1).cast("long"))))
    return turns.select("id", F.pmod(F.col("rank") - F.col("turn"), F.lit(ranks)).alias("rank"), "turn", "slot")


def repeat_lengths(df: DataFrame, id_col: str, ranks: int, repeat: int = 1) -> DataFrame:
    """rank, n: rows each rank really gets."""
    return repeat_no_pad(df, id_col, ranks, repeat).groupBy("rank").agg(F.count("*").alias("n"))


def round_robin(df: DataFrame, id_col: str, ranks: int, *, shuffle: bool = True, seed: int = 0, epoch: int = 0, drop_last: bool = False, skip: int = 0) -> DataFrame:
    """id, rank, slot: position p of the (shuffled) order goes to rank p % ranks.

    Without ``drop_last`` the order is padded from its start to a multiple of ``ranks``; with it, it
    is truncated.  The first ``skip`` slots of each rank are left out (resuming an epoch).
    """
    rows = df.select(id_col)
    n = rows.count()
    if drop_last and n % ranks:
        per_rank = math.ceil((n - ranks) / ranks) if n >= ranks else 0
    else:
        per_rank = math.ceil(n / ranks)
    if shuffle:
        rows = rows.withColumn("_key", F.md5(F.concat_ws(":", F.lit(str(seed + epoch)), F.col(id_col).cast("string")).cast("binary")))
        rows = global_index(rows, ["_key", id_col])
    else:
        rows = global_index(rows, [id_col])
    total = per_rank * ranks
    copies = math.ceil(total / n) if n else 0
    placed = rows.select(F.col(id_col).alias("id"), F.explode(F.sequence(F.col("idx"), F.col("idx") + n * max(copies - 1, 0), F.lit(max(n, 1)))).alias("p")) if copies else rows.select(F.col(id_col).alias("id"), F.col("idx").alias("p"))
    placed = placed.where(F.col("p") < total)
    return placed.select("id", F.pmod("p", F.lit(ranks)).cast("long").alias("rank"), F.floor(F.col("p") / ranks).cast("long").alias("slot")).where(F.col("slot") >= skip)


def round_robin_lengths(df: DataFrame, id_col: str, ranks: int, **options) -> DataFrame:
    return round_robin(df, id_col, ranks, **options).groupBy("rank").agg(F.count("*").alias("n"))
