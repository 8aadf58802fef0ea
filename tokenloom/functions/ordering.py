"""Global row numbers and running sums without a single-task window.

Rows are dealt to ranges of the order (as many as the session has shuffle partitions, or as adaptive
execution finds fit their size), sorted inside, and written once with ``checkpoint()``, so that a row's
range and its place there stay what they are when an executor is lost.  Only one number per range is
ever put together.  Rows that are equal in the order (a repeated or null key, however frequent) are told
apart by where they came from, so they spread over ranges like any others.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLACE_BITS = 33  # of a monotonically increasing id, below the number of the partition


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder of ``spark.checkpoint.dir``; a local one only where all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tokenloom-')}"
    return f"{root.rstrip('/')}/tokenloom/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written under the shared folder of ``spark.checkpoint.dir``; a folder of our own only where all runs in one process."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            path = f"file://{tempfile.mkdtemp(prefix='tokenloom-')}"
        sc.setCheckpointDir(path)
    return df.checkpoint()


def _ranged(df: DataFrame, order: list) -> DataFrame:
    """Rows in ranges of ``order``: _part is the range, _at the place in it."""
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    rows = checkpointed(rows.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie"))
    return rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << _PLACE_BITS) - 1))


def _with_base(rows: DataFrame, total: Column) -> DataFrame:
    """Adds _base: ``total`` of all ranges before the row's."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sums = rows.groupBy("_part").agg(total.alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(sums), "_part")  # one row per range


def global_index(df: DataFrame, order: list, out: str = "idx") -> DataFrame:
    """Adds the 0-based position of each row in ``order``."""
    rows = _with_base(_ranged(df, order), F.count("*"))
    return rows.select(*df.columns, (F.col("_base") + F.col("_at")).cast("long").alias(out))


def _sum_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for batch in batches:
        amount = np.nan_to_num(batch.column("_amount").to_numpy(zero_copy_only=False)).astype(np.int64)
        ends = total + np.cumsum(amount)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - amount)], names=[*batch.schema.names, "_inside"])
        total = int(ends[-1]) if len(ends) else total


def running_before(df: DataFrame, amount: Column, order: list, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` (null: 0) over all rows before this one in ``order``."""
    rows = _ranged(df.withColumn("_amount", amount.cast("long")), order).drop("_at")
    rows = rows.mapInArrow(_sum_before, T.StructType([*rows.schema.fields, T.StructField("_inside", T.LongType())]))  # a range is a partition, in order
    return _with_base(rows, F.sum("_amount")).select(*df.columns, (F.col("_base") + F.col("_inside")).cast("long").alias(out))
