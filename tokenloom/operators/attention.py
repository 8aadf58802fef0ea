"""Attention as joins.  Every form joins on the sample first; positions are compared inside it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.vectors import dot


def visible(q_pos: Column, k_pos: Column, k_attn: Column | None = None) -> Column:
    """Causal visibility: no later key, no masked key."""
    seen = k_pos <= q_pos
    return seen if k_attn is None else seen & (k_attn == 1)


def visible_counts(tokens: DataFrame, sample: str, pos: str, attn: str) -> DataFrame:
    """Keys that each query sees, as a running sum: the theta join is never made."""
    w = Window.partitionBy(sample).orderBy(pos).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return tokens.withColumn("n_visible", F.coalesce(F.sum(attn).over(w), F.lit(0)).cast("long"))


def fully_masked(tokens: DataFrame, sample: str, pos: str, attn: str) -> DataFrame:
    """Queries that see no key at all."""
    return visible_counts(tokens, sample, pos, attn).where("n_visible = 0")


def mask_form_of(attn: str, kernel: str, static_cache: bool = False) -> Column:
    """Aggregate: which mask the rows of a batch need, "none", "padding" (2-d) or "full" (4-d)."""
    if kernel not in ("eager", "flash", "sdpa"):
        raise ValueError(kernel)
    any_pad = F.max(F.when(F.col(attn) == 0, 1).otherwise(0)) == 1
    if kernel == "flash":
        return F.when(any_pad, "padding").otherwise("none")
    return F.when(any_pad, "full").otherwise("none") if kernel == "sdpa" and not static_cache else F.lit("full")


def mask_form(tokens: DataFrame, sample: str, attn: str, kernel: str, static_cache: bool = False) -> DataFrame:
    return tokens.groupBy(sample).agg(mask_form_of(attn, kernel, static_cache).alias("mask"))


def grouped_heads(q: DataFrame, kv: DataFrame, by: list[str], repeat: int) -> DataFrame:
    """Query head h uses key-value head h div ``repeat``; nothing is copied."""
    right = kv.withColumnRenamed("head", "kv_head")
    return q.withColumn("kv_head", F.floor(F.col("head") / repeat).cast(kv.schema["head"].dataType)).join(right, [*by, "kv_head"])


def attention(tokens: DataFrame, sample: str, pos: str, vec: str, *, causal: bool = True) -> DataFrame:
    """sample, pos, d, out in long form, for short sequences: scores, softmax and weighted sums in built-in functions."""
    q = tokens.select(F.col(sample).alias("s"), F.col(pos).alias("qp"), F.col(vec).alias("q"))
    k = tokens.select(F.col(sample).alias("s"), F.col(pos).alias("kp"), F.col(vec).alias("k"))
    on = q["s"] == k["s"]
    pairs = q.join(k, on & (k["kp"] <= q["qp"]) if causal else on).select(q["s"], "qp", "kp", (dot(F.col("q"), F.col("k")) / F.sqrt(F.size("q"))).alias("score"), "k")
    w = Window.partitionBy("s", "qp")
    weights = pairs.withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
    weights = weights.withColumn("p", F.col("e") / F.sum("e").over(w))
    cells = weights.select("s", "qp", "p", F.posexplode("k").alias("d", "v"))
    return cells.groupBy(F.col("s").alias(sample), F.col("qp").alias(pos), "d").agg(F.sum(F.col("p") * F.col("v")).alias("out"))


def attend(q: np.ndarray, k: np.ndarray, v: np.ndarray, causal: bool, q_first: int = 0) -> np.ndarray:
    """Softmax(q k' / sqrt(d)) v; query i is at position ``q_first`` + i."""
    s = q @ k.T / np.sqrt(q.shape[1])
    if causal:
        s = np.where(np.arange(len(k)) <= q_first + np.arange(len(q))[:, None], s, -np.inf)
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True) @ v


def blocked_attention(tokens: DataFrame, sample: str, pos: str, vec: str, *, causal: bool = True, block: int = 512) -> DataFrame:
    """sample, pos, out (array): the same result in Arrow blocks of queries, for long sequences.

    A sample's vectors are brought together (its length bounds the group); queries go block by
    block, so scores take block x length numbers.
    """
    key = tokens.schema[sample]
    schema = T.StructType([key, tokens.schema[pos], T.StructField("out", T.ArrayType(T.DoubleType()))])

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column(pos).to_numpy(), kind="stable")
        x = np.array(table.column(vec).to_pylist(), float)[order]
        out = [attend(x[a : a + block], x, x, causal, a) for a in range(0, len(x), block)]
        return pa.table({sample: table.column(sample).take(pa.array(order)), pos: table.column(pos).take(pa.array(order)), "out": pa.array(list(np.concatenate(out)), pa.list_(pa.float64()))})

    return tokens.select(sample, pos, vec).groupBy(sample).applyInArrow(run, schema)


def attend_stream(batches: Iterator[np.ndarray]) -> np.ndarray:
    """Attention of one query over keys that arrive in pieces (scores, values), with a running maximum."""
    best, weight, total = -np.inf, 0.0, 0.0
    for scores, values in batches:
        m = max(best, float(scores.max()))
        e = np.exp(scores - m)
        shrink = np.exp(best - m)
        weight, total, best = weight * shrink + e.sum(), total * shrink + e @ values, m
    return total / weight
