"""Connected components by alternating large-star and small-star steps, and bucket joins in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import stash

#: Rows of a bucket that one task compares with as many others.
BLOCK_ROWS = 1024
#: Keys that hold more than one in so many of all rows, so there are fewer of them than this, are joined by broadcast.
FREQUENT = 100_000
#: Rows of a key that never make it frequent.
FEW = 1000


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).collect()[0]
    return r["n"], r["x"] or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) that is not the least of its component; root: the least.

    Neighbours are never gathered: each step takes a minimum per node (partial sums first) and
    joins it back, so a hub with very many neighbours is a skewed join that can be split.
    """
    n = edges.count()
    edges = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", n)
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > u and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stash(large, "large-star", 2 * state[0])
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        moved = large.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stash(moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "small-star", 2 * state[0])
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def join_by_key(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined with a table of one row a key, in which ``count`` is the number of rows of the key; ``total``: of all keys.

    A key with over ``total`` / FREQUENT rows (and over FEW) would fill a task of the shuffled join, but there are fewer than
    FREQUENT such keys, so they are sent to all tasks instead.
    """
    most = max(FEW, total // FREQUENT)
    often = F.broadcast(per_key.where(F.col(count) > most).withColumn("_often", F.lit(True)))
    marked = rows.join(often, keys, "left")
    rest = marked.where("_often is null").select(*rows.columns).join(per_key.where(F.col(count) <= most), keys)
    return marked.where("_often").drop("_often").unionByName(rest)


def in_blocks(rows: DataFrame, keys: list[str], id_col: str, total: int, size: int = BLOCK_ROWS) -> DataFrame:
    """Rows of buckets with two or more, dealt to pairs of blocks (block_i <= block_j, own: the row's block); ``total``: their number at most.

    A bucket of n rows is cut into n / size blocks; each pair of blocks is a group of its own, so no
    group holds over about twice ``size`` rows however large the bucket is.
    """
    sizes = stash(rows.groupBy(*keys).agg(F.count("*").alias("bucket_rows")).where("bucket_rows > 1"), "bucket-sizes", total // 2)
    dealt = join_by_key(rows, sizes, keys, "bucket_rows", total).withColumn("blocks", F.ceil(F.col("bucket_rows") / size).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(id_col), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(*rows.columns, "own", F.least("own", "other").alias("block_i"), F.greatest("own", "other").alias("block_j"))


def whole(held: list[pa.RecordBatch], most: int | None = None) -> pa.RecordBatch:
    """Batches as one.  Columns of over 2 GB of text or bytes do not fit one batch (``most``: rows that do, for tests); they get 64-bit offsets."""
    if len(held) == 1:
        return held[0]
    table = pa.Table.from_batches(held)
    got = table.combine_chunks().to_batches(max_chunksize=most)
    if len(got) > 1:
        wide = {pa.string(): pa.large_string(), pa.binary(): pa.large_binary()}
        got = table.cast(pa.schema([f.with_type(wide.get(f.type, f.type)) for f in table.schema])).combine_chunks().to_batches()
    if len(got) != 1:
        raise ValueError(f"a group of {table.num_rows} rows does not fit one batch")
    return got[0]


def plain(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Columns with 64-bit offsets as Spark takes them; an error, not a loss, where they are too long."""
    slim = {pa.large_string(): pa.string(), pa.large_binary(): pa.binary()}
    if not any(f.type in slim for f in batch.schema):
        return batch
    return batch.cast(pa.schema([f.with_type(slim.get(f.type, f.type)) for f in batch.schema]))


def map_groups(rows: DataFrame, keys: list[str], run: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, partitions: int | None = None) -> DataFrame:
    """Apply ``run`` to each group of ``keys``: dealt by hash, sorted, cut in a stream (thousands of small groups a task).

    With ``partitions`` the groups stay dealt in so many; large groups are then not put together in one task.
    """
    names = rows.columns
    at = [names.index(k) for k in keys]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def full() -> Iterator[pa.RecordBatch]:
            if held:
                got = run(whole(held))
                if got is not None and got.num_rows:
                    yield plain(got)

        for batch in batches:
            if not batch.num_rows:
                continue
            keyed = [np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in at]
            change = np.zeros(batch.num_rows - 1, bool)
            for k in keyed:
                change |= k[1:] != k[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                key = tuple(k[a] for k in keyed)
                if key != last:
                    yield from full()
                    held, last = [], key
                held.append(batch.slice(a, b - a))
        yield from full()

    dealt = rows.repartition(partitions, *keys) if partitions else rows.repartition(*keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(stream, schema)
