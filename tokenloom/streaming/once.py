"""Messages reported once: the only stream-like operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(messages: DataFrame, keys: list[str], ts: str | None = None, horizon: str = "1 hour") -> DataFrame:
    """The first message of each kind; in a stream, once within the watermark."""
    if messages.isStreaming:
        if ts is None:
            raise ValueError("a stream needs its time column")
        return messages.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys)
    return messages.groupBy(*keys).agg(*([F.min(ts).alias(ts)] if ts else [F.count("*").alias("n")]))


def retry_wait(attempt: Column, initial: float = 1.0, factor: float = 2.0, most: float | None = None) -> Column:
    """Seconds before try ``attempt`` (from 1), capped."""
    wait = initial * F.pow(F.lit(float(factor)), attempt - 1)
    return wait if most is None else F.least(wait, F.lit(float(most)))
