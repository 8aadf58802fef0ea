"""Helpers shared by the training-data operators.

Intermediate results that must not be recomputed are written as Parquet under the shared
folder named by ``spark.checkpoint.dir`` (``stash``), so a lost executor costs a reread and
never a wrong or missing block.
"""

from __future__ import annotations

import gc
import struct
import tempfile
import uuid

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what separates words, as a regular expression class and as characters.
WORD = "[^\\x20\\x09-\\x0D]+"
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where none is configured and everything runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='tokenloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tokenloom/{name}-{uuid.uuid4().hex}"


#: Rows of a file where their number is known.
FILE_ROWS = 20_000


def stash(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that rereads it.

    ``rows``: how many there are at most, if known; small results then go to few files, whatever the number of partitions.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the files of shuffles that nothing refers to: Spark removes them when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Like ``stash``, dealt to buckets by ``key``, so that joins on it do not move the rows again.  The catalog keeps no entry."""
    spark, name = df.sparkSession, f"tokenloom_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("path", fresh_path(spark, "buckets")).option("compression", "uncompressed")
    writer.bucketBy(min(max(buckets, 1), 100_000), key).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved before the entry goes; the files stay, since the table is external
    spark.sql(f"DROP TABLE {name}")
    del df, writer
    free_shuffles(spark)
    return out


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and bind it in ``body`` (a one-element transform)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crc32_of_id(col: str = "doc_id") -> Column:
    return F.crc32(F.col(col).cast("string").cast("binary"))


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no input column has that name."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def narrow(x: np.ndarray) -> np.ndarray:
    """Integers in the narrowest type that holds them (0 or more: unsigned)."""
    if not len(x):
        return x.astype(np.uint8)
    low, high = int(x.min()), int(x.max())
    kinds = (np.uint8, np.uint16, np.uint32, np.uint64) if low >= 0 else (np.int8, np.int16, np.int32, np.int64)
    return x.astype(next(k for k in kinds if np.iinfo(k).min <= low and high <= np.iinfo(k).max))


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes."""
    head = struct.pack("<I", len(arrays)) + b"".join(a.dtype.str.encode().ljust(4) + struct.pack("<Q", len(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def load(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,), at, out = struct.unpack_from("<I", raw), 4 + 12 * struct.unpack_from("<I", raw)[0], []
    for k in range(n):
        kind, size = raw[4 + 12 * k : 8 + 12 * k].decode().strip(), struct.unpack_from("<Q", raw, 8 + 12 * k)[0]
        a = np.frombuffer(raw, kind, size, at)
        at += a.nbytes
        out.append(a)
    return out
