"""A keyed permutation of 0 .. n - 1: shuffled orders without a sort.

A Feistel network over the bits that n needs turns a number into another; a result beyond n - 1 is sent through
again until it falls below n (cycle walking), which is a permutation of 0 .. n - 1 for every key.  Rows are
numbered once; an epoch's order, a rank's share and the place to resume at are then arithmetic on each row, so
an epoch costs a scan, and a resumed one no more.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.ordering import global_index

ROUNDS = 6
#: Walks longer than this are refused.  Fewer than half of the numbers are beyond n, so one of 2**60 rows would need it with 64.
WALK = 128


def halves(n: int) -> tuple[int, int]:
    """Bits of the left and the right half."""
    bits = max(2, (n - 1).bit_length())
    return bits // 2, bits - bits // 2


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def _mixed(key: str, turn: int, half: Column, bits: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{key}:{turn}:"), half.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").bitwiseAND((1 << bits) - 1)


def _network(x: Column, key: str, n: int) -> Column:
    """One pass; x: (left, right) as one number.  Halves take turns, so unlike sizes are no trouble."""
    a, b = halves(n)

    def turn(k: int, state: Column) -> Column:
        left, right = F.shiftrightunsigned(state, b), state.bitwiseAND((1 << b) - 1)
        if k % 2:
            return F.shiftleft(left.bitwiseXOR(_mixed(key, k, right, a)), b) + right
        return F.shiftleft(left, b) + right.bitwiseXOR(_mixed(key, k, left, b))

    for k in range(ROUNDS):
        x = bound(x, partial(turn, k))  # once: a turn uses its state twice
    return x


def permuted(i: Column, n: int, key: str) -> Column:
    """Where row number ``i`` (0 .. n - 1) comes in the order of ``key``."""
    if n < 2:
        return i.cast("long")
    return bound(_network(i.cast("long"), key, n), lambda start: _walked(start, key, n))


def _walked(start: Column, key: str, n: int) -> Column:
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, lambda x, _: F.when(x < n, x).otherwise(_network(x, key, n)))
    out = F.when(start < n, start).otherwise(walked)
    return bound(out, lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("the walk is too long")).cast("long")))


def numbered(df: DataFrame, id_col: str) -> DataFrame:
    """id, idx: rows numbered by id, once for all epochs (write it to reuse it)."""
    return global_index(df.select(F.col(id_col).alias("id")), ["id"])


def permuted_ranks(rows: DataFrame, n: int, ranks: int, *, seed: int = 0, epoch: int = 0, shuffle: bool = True, drop_last: bool = False, skip: int = 0) -> DataFrame:
    """id, rank, slot of ``rows`` (id, idx of ``n`` in all): place p of the epoch's order is slot p div ranks of rank p mod ranks.

    As ``partition.round_robin``: without ``drop_last`` the order is padded from its start to a multiple of ``ranks``, with it cut
    to one; the first ``skip`` slots of each rank are left out.  Any part of the rows may be given: a rank's rows are those that
    it finds here, and no row is compared with another.
    """
    per_rank = n // ranks if drop_last else math.ceil(n / ranks)
    total, step = per_rank * ranks, max(n, 1)
    place = permuted(F.col("idx"), n, f"{seed}:{epoch}") if shuffle else F.col("idx")
    placed = rows.select("id", place.alias("p"))
    if total > n:
        placed = placed.select("id", F.explode(F.sequence(F.col("p"), F.lit(total - 1).cast("long"), F.lit(step).cast("long"))).alias("p"))
    kept = placed.where((F.col("p") < total) & (F.col("p") >= skip * ranks))
    return kept.select("id", (F.col("p") % ranks).alias("rank"), F.floor(F.col("p") / ranks).cast("long").alias("slot"))


def permutation_sql(i: str, n: str, key: str) -> str:
    """The same as DuckDB SQL; ``n``: an expression that does not change from row to row, ``key``: a text."""
    bits = f"greatest(2, CAST(ceil(log2({n})) AS BIGINT))"
    a, b = f"({bits} // 2)", f"({bits} - {bits} // 2)"

    def mixed(turn: int, half: str, width: str) -> str:
        return f"(CAST('0x' || substr(md5('{key}:{turn}:' || {half}), 1, 15) AS BIGINT) & ((CAST(1 AS BIGINT) << {width}) - 1))"

    def turn(k: int) -> str:
        left, right = f"(s >> {b})", f"(s & ((CAST(1 AS BIGINT) << {b}) - 1))"
        if k % 2:
            return f"((xor({left}, {mixed(k, right, a)}) << {b}) + {right})"
        return f"(({left} << {b}) + xor({right}, {mixed(k, left, b)}))"

    turns = " ".join(f"WHEN t = {k} THEN {turn(k)}" for k in range(ROUNDS))
    # Steps of all passes in a row; a step that begins a pass does nothing once the number is below n.
    step = f"CASE WHEN done THEN s ELSE CASE {turns} END END"
    return f"""
walk AS (
  SELECT {i} AS i, CAST({i} AS BIGINT) AS s, 0 AS t, false AS done FROM numbers
  UNION ALL
  SELECT i, {step} AS s, (t + 1) % {ROUNDS}, (t = {ROUNDS - 1} AND ({step}) < {n}) FROM walk WHERE NOT done
),
placed AS (SELECT i, s AS p FROM walk WHERE done)"""
