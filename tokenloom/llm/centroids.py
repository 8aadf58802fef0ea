"""Centroid clustering in exact integers, with partial-distance search.

Components become integers floor(scale * x).  A batch of vectors is compared with all centroids over the
dimensions of highest variance first, a few at a time.  Each vector's best partial centroid is finished at
once, and its distance is the current best; any other centroid whose partial sum is strictly above it is
abandoned, and only the survivors finish all dimensions.  The result is that of the full search.

Only the centroids (k rows of ``dim`` integers) and their sums (k rows a round) pass through the driver; a
task adds up its vectors per cluster before the shuffle, so it sends k rows whatever the clusters' sizes.

Defined results: vectors that are null, have another number of components, hold null or non-finite
components, or integers beyond 2**27 in size (squares would not fit 64 bits) are left out; ties go to the
smaller centroid; rows with one vec_id or equal vectors count each for itself, and equal hashes are ordered
by the vector; a null vec_id hashes as the empty text; with fewer than k vectors there are as many
centroids; sums beyond 64 bits are shown as 2**63 - 1; empty table: empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import stash

CLUSTERS, ROUNDS, SEED = 16, 3, 1
DIM, SCALE = 64, 64
LARGEST = 1 << 27
#: Dimensions that are added before centroids are abandoned again.
STEP = 8


def kept_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """id, q (array of long) of the vectors that take part."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.size(x) == dim
    fine &= F.forall(x, lambda v: F.coalesce((F.abs(v * scale) < float(LARGEST)) & ~F.isnan(v), F.lit(False)))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(x, lambda v: F.floor(v * scale)).alias("q"))


def matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def nearest(x: np.ndarray, c: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest row of ``c`` (ties: the smaller) and the squared distance; ``order``: dimensions, first ones first."""
    x, c = np.ascontiguousarray(x[:, order]), np.ascontiguousarray(c[:, order])
    rows, dim = np.arange(len(x)), x.shape[1]
    partial = ((x[:, None, :step] - c[None, :, :step]) ** 2).sum(axis=2)
    first = partial.argmin(axis=1)
    best = partial[rows, first] + ((x[:, step:] - c[first, step:]) ** 2).sum(axis=1)
    found = np.full(partial.shape, np.iinfo(np.int64).max)
    found[rows, first] = best
    i, j = np.nonzero(partial <= best[:, None])
    i, j = i[j != first[i]], j[j != first[i]]
    sums = partial[i, j]
    for a in range(step, dim, step):
        sums = sums + ((x[i, a : a + step] - c[j, a : a + step]) ** 2).sum(axis=1)
        alive = sums <= best[i]
        i, j, sums = i[alive], j[alive], sums[alive]
    found[i, j] = sums
    number = found.argmin(axis=1)
    return number, found[rows, number]


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of least sha256 of "seed:id"."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r["q"] for r in kept.select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()], np.int64)  # k rows


def _wide(entry: Column) -> Column:
    return F.sum(entry.cast("decimal(38,0)"))


def _added(parts: DataFrame, keys: list[str], dim: int, *names: str) -> list:
    """Per-task rows (keys, n, arrays ``names``) added up: exact sums, one row a key at the driver."""
    sums = [_wide(F.get(name, F.lit(d))).alias(f"{name}{d}") for name in names for d in range(dim)]
    return parts.groupBy(*keys).agg(_wide(F.col("n")).alias("n"), *sums).collect()


def dimension_order(kept: DataFrame, dim: int = DIM) -> np.ndarray:
    """Dimensions by falling variance over all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, s2 = 0, np.zeros(dim), np.zeros(dim)
        for batch in batches:
            x = matrix(batch, dim)
            n, s, s2 = n + len(x), s + x.sum(axis=0), s2 + (x.astype(float) ** 2).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"n": [n], "s": [s], "s2": [s2]}, schema=pa.schema([("n", pa.int64()), ("s", pa.list_(pa.float64())), ("s2", pa.list_(pa.float64()))]))

    parts = kept.select("q").mapInArrow(run, "n long, s array<double>, s2 array<double>")
    sums = [F.sum(F.get(name, F.lit(d))).alias(f"{name}{d}") for name in ("s", "s2") for d in range(dim)]
    r = parts.agg(F.sum("n").alias("n"), *sums).collect()[0]
    if not r["n"]:
        return np.arange(dim)
    mean, square = (np.array([r[f"{name}{d}"] for d in range(dim)]) / r["n"] for name in ("s", "s2"))
    return np.argsort(-(square - mean**2), kind="stable")


def moved(kept: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Centroids after one round: componentwise floor(sum / count); empty ones stay."""
    dim = centroids.shape[1]
    shared = kept.sparkSession.sparkContext.broadcast((centroids, order))  # k rows
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, by = shared.value
        n, s = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for batch in batches:
            x = matrix(batch, dim)
            at = nearest(x, c, by)[0]
            n += np.bincount(at, minlength=len(c))
            for k in np.unique(at):
                s[k] += x[at == k].sum(axis=0)
        yield pa.RecordBatch.from_pydict({"cluster": np.flatnonzero(n).astype(np.int32), "n": n[n > 0], "s": list(s[n > 0])}, schema=schema)

    out = centroids.copy()
    for r in _added(kept.select("q").mapInArrow(run, "cluster int, n long, s array<long>"), ["cluster"], dim, "s"):
        out[r["cluster"]] = [int(r[f"s{d}"]) // int(r["n"]) for d in range(dim)]
    return out


def assigned(kept: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    """id, cluster, distance of every kept vector."""
    dim = centroids.shape[1]
    shared = kept.sparkSession.sparkContext.broadcast((centroids, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, by = shared.value
        for batch in batches:
            at, distance = nearest(matrix(batch, dim), c, by)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(at, pa.int32()), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"])

    return kept.mapInArrow(run, kept.select("id").schema.add("cluster", "integer").add("distance", "long"))


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, *, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector, and the final centroids."""
    kept = kept_vectors(vectors, id_col=id_col, vec_col=vec_col, dim=dim, scale=scale)
    centroids, order = first_centroids(kept, k, seed).reshape(-1, dim), dimension_order(kept, dim)
    if not len(centroids):
        return kept.select("id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]), centroids
    for _ in range(rounds):
        centroids = moved(kept, centroids, order)
    rows = stash(assigned(kept, centroids, order), "clusters")
    within = rows.groupBy("cluster").agg(_wide(F.col("distance")).alias("within"))
    total = F.sum("within").over(Window.partitionBy(F.lit(0)))  # k rows
    shown = lambda c: F.least(c, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    names = F.array(*[F.lit(digest(c)) for c in centroids])
    per = within.select("cluster", shown(F.col("within")).alias("cluster_inertia"), shown(total).alias("inertia"), F.get(names, F.col("cluster")).alias("centroid_sha256"))
    return rows.join(F.broadcast(per), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
