"""Attention and matrix products in tiles, for sequences and weights that no single task could hold.

Attention: positions are cut into blocks.  A task gets a strip of query blocks and a run of key blocks one after
the other, and keeps, for each query, the greatest score, the sum of weights and the weighted sum of values
(a running softmax).  The runs of a query are merged by the same rule, which is associative, so a sequence of
any length is many small tasks, and a task holds a strip of queries and one block of keys.  What is sent does not
grow with the square of the length, as the work does: keys are sent once for each strip from theirs on, queries once
for each run, and a sequence has ``STRIPS`` strips and ``RUNS`` runs at most, unless a strip would pass ``STRIP`` queries.

Products: weights are a table of tiles, vectors are cut into pieces.  A task makes one tile of outputs of one
group of rows, going through the inner index, so neither a matrix nor a long row is ever in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Positions of a block, and key blocks that one task goes through at least.
BLOCK, RUN = 1024, 16
#: Strips and runs of a sequence, queries of a strip at most, and queries that meet a key block in one product.
STRIPS, RUNS, STRIP, ROWS = 8, 2, 32_768, 1024
TILE = 256


def _matrix(column: pa.Array, at: int) -> np.ndarray:
    """The array of arrays in row ``at`` as a matrix."""
    rows = column.slice(at, 1).flatten()
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))


def fold(state: tuple[np.ndarray, np.ndarray, np.ndarray] | None, scores: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(greatest score, weight, weighted values) of each query with one more block; scores of unseen keys are -inf; axes before the last two are sequences side by side."""
    top = scores.max(axis=-1, initial=-np.inf)
    best = top if state is None else np.maximum(state[0], top)
    e = np.exp(scores - np.where(np.isfinite(best), best, 0)[..., None])
    weight, total = e.sum(axis=-1), e @ values
    if state is not None:
        shrink = np.exp(np.where(np.isfinite(best), state[0], -np.inf) - np.where(np.isfinite(best), best, 0))
        weight, total = weight + state[1] * shrink, total + state[2] * shrink[..., None]
    return best, weight, total


def merge_runs(partials: DataFrame, keys: list[str]) -> DataFrame:
    """keys and out: partial (best, weight, total) of one query put together; out is null if it sees no key.

    A query has one partial for each run of key blocks up to its own.
    """
    best = F.array_max(F.transform("parts", lambda p: p["best"]))
    scaled = lambda p: F.exp(p["best"] - F.col("top"))
    rows = partials.groupBy(*keys).agg(F.collect_list(F.struct("best", "weight", "total")).alias("parts"))
    rows = rows.withColumn("parts", F.filter("parts", lambda p: p["weight"] > 0)).withColumn("top", best)
    weight = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["weight"] * scaled(p))
    zero = F.transform(F.get("parts", F.lit(0))["total"], lambda _: F.lit(0.0))
    total = F.aggregate("parts", zero, lambda s, p: F.zip_with(s, p["total"], lambda a, b: a + b * scaled(p)))
    rows = rows.withColumn("weight", weight)
    return rows.select(*keys, F.when(F.size("parts") > 0, F.transform(total, lambda x: x / F.col("weight"))).alias("out"))


def tiled_attention(q: DataFrame, kv: DataFrame, *, sample: str = "sample_id", pos: str = "pos", head: str | None = None, kv_repeat: int = 1, causal: bool = True, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """sample, (head,) pos, out.  ``q``: sample, (head,) pos, q; ``kv``: sample, (head,) pos, k, v (arrays).

    Query head h uses key-value head h div ``kv_repeat``, without copies of keys.  Keys that are padding are left out of
    ``kv`` beforehand; a query that sees no key has a null ``out``.  Positions are integers from 0 and differ in a sample and head.
    """
    key = q.schema[sample].dataType
    qh = F.col(head).cast("long") if head else F.lit(0).cast("long")
    left = q.select(F.col(sample).alias("s"), F.floor(qh / kv_repeat).cast("long").alias("h"), (qh % kv_repeat).alias("lane"), F.col(pos).cast("long").alias("p"), F.col("q").cast("array<double>").alias("x"))
    right = kv.select(F.col(sample).alias("s"), (F.col(head).cast("long") if head else F.lit(0).cast("long")).alias("h"), F.col(pos).cast("long").alias("p"), F.col("k").cast("array<double>").alias("x"), F.col("v").cast("array<double>").alias("y"))
    at = F.floor(F.col("p") / block).cast("long")

    # At most block * kv_repeat rows a group.
    queries = left.groupBy("s", "h", at.alias("qb")).agg(F.array_sort(F.collect_list(F.struct("p", "lane", "x"))).alias("r"))
    keys = right.groupBy("s", "h", at.alias("kb")).agg(F.array_sort(F.collect_list(F.struct("p", "x", "y"))).alias("r"))
    field = lambda name: F.transform("r", lambda e: e[name])
    reach = left.groupBy("s", "h", at.alias("qb")).count().groupBy("s", "h").agg(F.max("qb").alias("last_q"), F.max("count").alias("most"))
    extent = right.groupBy("s", "h").agg(F.max(at).alias("last_k"))
    share = lambda last, n: F.ceil((F.col(last) + 1) / n).cast("long")
    strip = F.greatest(F.least(share("last_q", STRIPS), F.floor(STRIP / F.col("most")).cast("long")), F.lit(1).cast("long"))
    spans = reach.join(extent, ["s", "h"], "left").withColumn("last_k", F.coalesce("last_k", F.lit(0)))  # a row a sample and head
    spans = spans.withColumn("strip", strip).withColumn("run_of", F.greatest(share("last_k", RUNS), F.lit(run).cast("long")))

    place = lambda of, size: F.floor(F.col(of) / F.col(size)).cast("long")
    queries = queries.join(spans, ["s", "h"]).withColumn("qs", place("qb", "strip"))
    upto = F.least((F.col("qs") + 1) * F.col("strip") - 1, "last_q", "last_k") if causal else F.col("last_k")
    runs = F.sequence(F.lit(0).cast("long"), F.floor(upto / F.col("run_of")).cast("long"))
    asked = queries.select("s", "h", "qs", F.explode(runs).alias("run"), F.lit(-1).cast("long").alias("kb"), field("p").alias("p"), field("lane").alias("lane"), field("x").alias("x"), F.array().cast("array<array<double>>").alias("y"))
    first = place("kb", "strip") if causal else F.lit(0).cast("long")
    sent = keys.join(spans, ["s", "h"]).where(first <= place("last_q", "strip"))
    sent = sent.select("s", "h", F.explode(F.sequence(first, place("last_q", "strip"))).alias("qs"), place("kb", "run_of").alias("run"), "kb", field("p").alias("p"), F.array().cast("array<long>").alias("lane"), field("x").alias("x"), field("y").alias("y"))
    dealt = asked.unionByName(sent).repartition("s", "h", "qs", "run").sortWithinPartitions("s", "h", "qs", "run", "kb")
    schema = T.StructType([T.StructField("s", key), *[T.StructField(n, T.LongType()) for n in ("h", "lane", "p")], *[T.StructField(n, T.DoubleType()) for n in ("best", "weight")], T.StructField("total", T.ArrayType(T.DoubleType()))])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, asking, parts = None, [], []  # parts: [key, positions, lanes, queries, state] of some queries each

        def done() -> Iterator[pa.RecordBatch]:
            for s, h, p, lane, x, state in gathered() if asking else parts:
                best, weight, total = state or (np.full(len(p), -np.inf), np.zeros(len(p)), np.zeros((len(p), 0)))
                n = len(p)
                cells = [pa.array([s.as_py()] * n, s.type), pa.array([h] * n, pa.int64()), pa.array(lane, pa.int64()), pa.array(p, pa.int64())]
                yield pa.RecordBatch.from_arrays([*cells, pa.array(best), pa.array(weight), pa.array(list(total), pa.list_(pa.float64()))], names=["s", "h", "lane", "p", "best", "weight", "total"])

        def gathered() -> list:
            """Query blocks of a strip in order of position, put together or cut to ``ROWS`` queries."""
            s, h = last[:2]
            blocks = sorted(asking, key=lambda b: b[0][0])
            p, lane, x = (np.concatenate([b[i] for b in blocks]) for i in range(3))
            return [[s, h, p[a : a + ROWS], lane[a : a + ROWS], x[a : a + ROWS], None] for a in range(0, len(p), ROWS)]

        for batch in batches:
            s, (h, qs, of, kb) = batch.column("s"), (batch.column(n).to_pylist() for n in ("h", "qs", "run", "kb"))
            p, lane = batch.column("p"), batch.column("lane")
            for i in range(batch.num_rows):
                at = s[i], h[i], qs[i], of[i]
                if at != last:
                    if last is not None:
                        yield from done()
                    last, asking, parts = at, [], []
                if kb[i] < 0:
                    asking.append((p[i].values.to_numpy(), lane[i].values.to_numpy(), _matrix(batch.column("x"), i)))
                    continue
                if asking:
                    parts, asking = gathered(), []
                here, x, y = p[i].values.to_numpy(), _matrix(batch.column("x"), i), _matrix(batch.column("y"), i)
                for part in parts:
                    own, q = part[2], part[4]
                    if causal and here[0] > own[-1]:
                        continue  # none of these queries sees the block
                    scores = q @ x.T / np.sqrt(q.shape[1])
                    if causal and here[-1] > own[0]:
                        scores = np.where(here <= own[:, None], scores, -np.inf)
                    part[5] = fold(part[5], scores, y)
        if last is not None:
            yield from done()

    merged = merge_runs(dealt.mapInArrow(stream, schema), ["s", "h", "lane", "p"])
    heads = [(F.col("h") * kv_repeat + F.col("lane")).cast(q.schema[head].dataType).alias(head)] if head else []
    return merged.select(F.col("s").alias(sample), *heads, F.col("p").cast(q.schema[pos].dataType).alias(pos), "out")


# ---------------------------------------------------------------- matrix products

_CELLS = "array<struct<o:int,i:int,w:double>>"


def weight_tiles(entries: DataFrame, *, row: str = "o", col: str = "i", value: str = "w", tile: int = TILE) -> DataFrame:
    """(ob, ib, cells) from entries (o, i, w) of a matrix: one row a tile of ``tile`` x ``tile``; entries that are missing are zeros."""
    place = F.struct((F.col(row) % tile).cast("int").alias("o"), (F.col(col) % tile).cast("int").alias("i"), F.col(value).cast("double").alias("w"))
    return entries.groupBy(F.floor(F.col(row) / tile).cast("long").alias("ob"), F.floor(F.col(col) / tile).cast("long").alias("ib")).agg(F.collect_list(place).alias("cells"))  # tile ** 2 at most


def bias_tiles(entries: DataFrame, *, row: str = "o", value: str = "b", tile: int = TILE) -> DataFrame:
    """(ob, cells) from entries (o, b)."""
    place = F.struct((F.col(row) % tile).cast("int").alias("o"), F.lit(0).alias("i"), F.col(value).cast("double").alias("w"))
    return entries.groupBy(F.floor(F.col(row) / tile).cast("long").alias("ob")).agg(F.collect_list(place).alias("cells"))


def row_pieces(rows: DataFrame, *, id_col: str, vec: str, tile: int = TILE) -> DataFrame:
    """(id, ib, x): vectors cut into pieces of ``tile`` entries; empty and null vectors have none."""
    n = F.ceil(F.size(vec) / tile).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(F.col(vec), k * tile + 1, tile))
    return rows.where(F.size(vec) > 0).select(F.col(id_col).cast("long").alias("id"), F.posexplode(cut).alias("ib", "x")).select("id", F.col("ib").cast("long").alias("ib"), F.col("x").cast("array<double>").alias("x"))


def groups_of(n_rows: int, height: int = 1024) -> int:
    """Into how many groups rows are dealt, so that each has about ``height``."""
    return max(1, -(-n_rows // height))


def tiled_linear(pieces: DataFrame, tiles: DataFrame, *, outputs: int, groups: int, bias: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """(id, ib, x): pieces of x W' (+ b), cut like ``pieces``; ``outputs``: rows of W.

    Ids are integers and differ.  No weight is in a closure.  A task makes one tile of outputs of one group of rows: it gets the
    group's pieces and the weight tiles in order of the inner index and adds up their products, so it holds one of each and the
    sums.  Both sides are sent once for each tile of the other, in a single shuffle.
    """
    n_out = -(-outputs // tile)
    each_group, each_tile = (F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))) for n in (groups, n_out))
    packed = pieces.groupBy(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("long").alias("rb"), "ib").agg(F.array_sort(F.collect_list(F.struct("id", "x"))).alias("r"))  # a group's rows
    left = packed.select("rb", each_tile.alias("ob"), "ib", F.lit(0).alias("kind"), F.transform("r", lambda e: e["id"]).alias("ids"), F.transform("r", lambda e: e["x"]).alias("x"), F.array().cast(_CELLS).alias("cells"))

    def sent(table: DataFrame, ib: Column, kind: int) -> DataFrame:
        return table.select(each_group.alias("rb"), F.col("ob").cast("long").alias("ob"), ib.cast("long").alias("ib"), F.lit(kind).alias("kind"), F.array().cast("array<long>").alias("ids"), F.array().cast("array<array<double>>").alias("x"), F.col("cells").cast(_CELLS).alias("cells"))

    both = left.unionByName(sent(tiles.where(F.col("ob") < n_out), F.col("ib"), 1))
    if bias is not None:
        both = both.unionByName(sent(bias.where(F.col("ob") < n_out), F.lit(0), 2))
    dealt = both.repartition("rb", "ob").sortWithinPartitions("rb", "ob", "ib", "kind")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, sums = None, np.zeros(0, np.int64), np.zeros((0, 0))
        x, at, x_of = sums, ids, -1

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), last[1])), pa.array(list(sums), pa.list_(pa.float64()))], names=["id", "ib", "x"])

        for batch in batches:
            rb, ob, ib, kind = (batch.column(n).to_numpy() for n in ("rb", "ob", "ib", "kind"))
            for i in range(batch.num_rows):
                if (rb[i], ob[i]) != last:
                    if len(ids):
                        yield done()
                    last, ids, x_of = (rb[i], ob[i]), np.zeros(0, np.int64), -1
                if kind[i] == 0:
                    x, x_of = _matrix(batch.column("x"), i), ib[i]
                    own = batch.column("ids").slice(i, 1).flatten().to_numpy(zero_copy_only=False)
                    if not len(ids):  # every row has a first piece
                        ids, sums = own, np.zeros((len(own), min(tile, outputs - int(ob[i]) * tile)))
                    at = np.searchsorted(ids, own)
                elif len(ids):
                    cells = batch.column("cells").slice(i, 1).flatten()
                    o, c, w = (cells.field(n).to_numpy(zero_copy_only=False) for n in ("o", "i", "w"))
                    fits = o < sums.shape[1]
                    if kind[i] == 2:
                        sums[:, o[fits]] += w[fits]
                    elif x_of == ib[i]:
                        block = np.zeros((tile, sums.shape[1]))
                        block[c[fits], o[fits]] = w[fits]
                        sums[at] += x @ block[: x.shape[1]]
        if len(ids):
            yield done()

    return dealt.mapInArrow(stream, "id long, ib long, x array<double>")


def gated_product(gate: DataFrame, up: DataFrame) -> DataFrame:
    """silu(gate) * up of two results of ``tiled_linear``, joined by id and tile."""
    right = up.withColumnRenamed("x", "u")
    return gate.join(right, ["id", "ib"]).select("id", "ib", F.zip_with("x", "u", lambda g, u: g / (1 + F.exp(-g)) * u).alias("x"))


def tiled_mlp(pieces: DataFrame, gate: DataFrame, up: DataFrame, down: DataFrame, *, inner: int, outputs: int, groups: int, tile: int = TILE) -> DataFrame:
    """down(silu(gate x) * up x), all weights as tables of tiles."""
    g, u = (tiled_linear(pieces, w, outputs=inner, groups=groups, tile=tile) for w in (gate, up))
    return tiled_linear(gated_product(g, u), down, outputs=outputs, groups=groups, tile=tile)


def rows_of_pieces(pieces: DataFrame) -> DataFrame:
    """(id, v): the pieces of a row one after the other (as many as it has entries)."""
    return pieces.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ib", "x"))), lambda e: e["x"])).alias("v"))
